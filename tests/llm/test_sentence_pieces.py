import functools
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import sentence_pieces as s

MODEL = public_tokenizers.path(s.VOCABULARY)
ODD = [
    "", " ", "   ", "Hello  world", "  lead", "trail  ", "a \t b\n\n c", "ﬁne ①Å\xa0x", "a　b", "▁x ▁▁ y▁", "<s> </s> <unk> <0x0A>", "\x00z\x7f", "é é Ạ̊", "漢字かな交じり文。" * 30, "\U0001f9ff\U0001f468‍\U0001f469 q",
    "​", "​​ x", "x​ ​ y", "\xa0 　", "ｱﾞ ½ ㌔ …    z", "¨a ´", " ¨", "aaaa " * 50, "x" * 500, "가각힣 ㅎㅏㄴ", "שׁﷺ end",
]


@functools.cache
def models():
    """The given model, and copies of it with rules and white space of other kinds."""
    raw = open(MODEL, "rb").read()
    out = [raw]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        rules = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        for first in (0, 1):
            for few in (0, 1):
                spec = rules + bytes([3 << 3, first, 4 << 3, few, 5 << 3, 1])
                size, n = b"", len(spec)
                while n > 127:
                    size, n = size + bytes([n & 127 | 128]), n >> 7
                out.append(raw + bytes([3 << 3 | 2]) + size + bytes([n]) + spec)
    return out


def spans(library, text):
    """Spans of the library's own."""
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def texts(n):
    r = random.Random(7)
    chars = "ab  é̈\t\nÅﬁ①　漢▁.,​\U0001f9ff½\xa0¨"
    return ODD + ["".join(r.choice(chars) for _ in range(r.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("k", range(9))
def test_ids_and_spans_are_the_librarys(k):
    model = models()[k]
    mine, library = s.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in texts(1500):
        ids, begins, ends = (x.tolist() for x in mine.encode(text, False, False))
        assert mine.normalizer.normalize(text)[0] == library.normalize(text), (k, text)
        assert list(zip(ids, begins, ends, strict=True)) == spans(library, text), (k, text)
    for text in ODD:
        assert mine.encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_rules_are_those_of_the_map():
    spec = sentencepiece.SentencePieceNormalizer(norm_map=[("ab", "x"), ("abc", "yz"), ("q", "")])
    compiled = dict(s._fields(spec.serialized_normalizer_spec()))[s.CHARACTER_MAP]
    rules = s.read_character_map(compiled)
    assert rules["ab"] == "x" and rules["abc"] == "yz" and rules["q"] == ""
    out, source = s.Normalizer(rules, True, False, True).normalize("abcab qé abd")
    assert out == "▁yzx▁é▁xd" and source.tolist() == [0, 0, 0, 3, 5, 7, 9, 10, 12, 13]


def test_blocks_and_memory_do_not_show(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu漢é") for _ in range(r.randint(1, 9))) for _ in range(400)]
    text = "".join(r.choice(words) + r.choice([" ", "  ", "\n", ""]) for _ in range(3000))
    monkeypatch.setattr(s, "BLOCK_CHARS", 100)
    monkeypatch.setattr(s, "MEMORY", 50)
    monkeypatch.setattr(s, "UNIT_CHARS", 5)
    mine = s.Pieces(open(MODEL, "rb").read())
    assert list(zip(*(x.tolist() for x in mine.encode(text, False, False)), strict=True)) == spans(library, text)


def test_whole_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(ODD), (None, "x"), (900, None), (3, ODD[3]), (901, "long words " * 200_000)]
    docs = spark.createDataFrame([(i, t, 5, [1]) for i, t in rows], "doc_id long, text string, n_tokens int, ids array<int>")
    got = s.decode(s.encode(docs, MODEL), MODEL).drop("spans_sha256").collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), library.decode(ids)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert s.decode(s.encode(docs.limit(0), MODEL), MODEL).count() == 0
    began = time.perf_counter()
    s.pieces(MODEL).encode("ab\n" * 700_000 + "x" * 700_000)
    assert time.perf_counter() - began < 30


def test_given_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in s.op12_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"], add_bos=True, add_eos=True)
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        assert list(got[d["doc_id"]][:4]) == [d["doc_id"], len(ids), *sha]
        pairs = np.array([(0, 0), *((b, e) for _, b, e in spans(library, d["text"])), (len(d["text"].encode()),) * 2], "<u4")
        assert got[d["doc_id"]]["spans_sha256"] == hashlib.sha256(pairs).hexdigest()
