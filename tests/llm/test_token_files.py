import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers

from tidemark.llm import token_files as t

MODEL = tokenizers.Tokenizer.from_file(t.tokenizer_path())


def ids(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids


def encoded(coder, texts, end_id=2):
    n, flat = coder.encode(pa.array(texts, pa.string()), end_id)
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("memory", [0, 1 << 24])
def test_pieces_give_the_ids_of_the_whole(monkeypatch, memory):
    monkeypatch.setattr(t, "MEMORY_BYTES", memory)
    r = random.Random(1)
    parts = list("abcA1 '\n\t.,#é　\u0085\x1c\x0b_²½") + ["don't", " the", " a", " ,", " \n ", "hello", "  ", "😀", "\nA", ".\n", "́", "<|endoftext|>"]
    coder = t.Encoder(t.tokenizer_path())
    assert coder.by_pieces
    for _ in range(40):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(500)] + [None, "", " ", "  x"]
        for text, got in zip(texts, encoded(coder, texts), strict=True):
            assert got == [*ids(text), 2], text


def test_given_documents(spark):
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert encoded(t.Encoder(t.tokenizer_path()), texts) == [[*ids(x), 2] for x in texts]


def test_another_vocabulary_gives_the_ids_of_its_tokenizer(spark):
    path = t.tokenizer_path("word_bpe_49k.json")
    model, coder = tokenizers.Tokenizer.from_file(path), t.Encoder(path)
    texts = ["The  Quick, brown\nfox's 12 é", None, "", "<|endoftext|> a"]
    assert not coder.by_pieces
    assert encoded(coder, texts, 7) == [[*model.encode(x or "", add_special_tokens=False).ids, 7] for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.tokens for x in t.write_tokens(docs, tokenizer=path).collect()}
    assert got[0] == [*model.encode(texts[0], add_special_tokens=False).ids, 2]


def test_chunks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(t, "CHUNK_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 4, None, "b" * 40, "c" * 4, "d" * 6, ""])], ["i", "t"])
    parts = [p.column(0).to_pylist() for p in t._chunks(batch)]
    assert parts == [[0, 1], [2], [3, 4, 5]]
    assert list(t._chunks(batch.slice(0, 0))) == []


def test_round_trip(spark, tmp_path):
    rows = [(5, "b c"), (-3, "first"), (7, None), (6, ""), (5, "a b"), (None, "none"), (8, "long text " * 30_000), (5, "a b")]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, seq int, n_tokens string").repartition(3)
    files = t.write_tokens(docs, f"{tmp_path}/tokens")
    want = sorted(([*ids(text), 2] for _, text in rows), key=str)
    assert sorted((list(x.tokens) for x in files.collect()), key=str) == want
    got = sorted(t.read_digests(files).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None, -3, 5, 5, 5, 6, 7, 8]
    at = 0
    by_seq = {x.start: x for x in got}
    for x in sorted(files.collect(), key=lambda x: x.seq):
        d = by_seq[at]
        assert (d.doc_id, d.n_tokens, d.ids_crc32) == (x.doc_id, len(x.tokens), zlib.crc32(np.array(x.tokens, "<u4").tobytes()))
        at += len(x.tokens)
    meta = [pq.ParquetFile(p).metadata for p in Path(f"{tmp_path}/tokens").glob("*.parquet")]
    columns = [m.row_group(0).column(k) for m in meta if m.num_row_groups for k in range(m.num_columns)]
    assert any("DICTIONARY" in str(c.encodings) for c in columns if c.path_in_schema.startswith("tokens"))
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "doc_id")
    assert all(c.has_offset_index for c in columns)


def test_empty_table(spark):
    assert t.read_digests(t.write_tokens(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_a_few_documents_are_read_without_the_other_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "PAGE_BYTES", 1 << 10)
    docs = spark.createDataFrame([(k, f"text number {k} of many " * 20) for k in range(40_000)], "doc_id long, text string")
    files = t.write_tokens(docs, f"{tmp_path}/tokens")
    some = t.read_tokens(files, 31_000, 31_009)
    assert sorted(x.doc_id for x in some.collect()) == list(range(31_000, 31_010))
    plan = some._jdf.queryExecution().executedPlan()
    scanned = next(line for line in _scans(plan))
    assert 10 <= scanned < 12_000  # of 40,000 rows: pages of doc_id outside the bounds are skipped
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", t.places(files)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert schemas and not any("array" in x for x in schemas)


def _scans(plan):
    """The output rows of the scans of an executed plan."""
    if plan.nodeName().startswith("Scan"):
        yield plan.metrics().apply("numOutputRows").value()
    for name in ("executedPlan", "plan"):
        if hasattr(plan, name) and plan.nodeName().startswith(("AdaptiveSparkPlan", "ShuffleQueryStage")):
            yield from _scans(getattr(plan, name)())
    children = plan.children()
    for k in range(children.size()):
        yield from _scans(children.apply(k))
