"""Token-ID output: Parquet files with one row for each document.

The ids lie in a list column with a dictionary (ids repeat, so a few bits hold
each), the other columns in delta encoding. Row groups and pages are small, and
the writer leaves page indexes, so that a reader of a few documents, or of the
metadata alone, skips the rest. Files follow ascending doc_id: rows are dealt
by ranges of it and sorted within each, and `seq` (range number and place)
keeps the order, so that places of documents in the whole come from the counts.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.tables import releasing, shuffle_partitions, small_batches, table
from tidemark.session import durable

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text that are encoded at once, about; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Most bytes of pieces and their ids that a worker remembers from chunk to chunk.
MEMORY_BYTES = 16 << 20
#: How byte-level vocabularies write bytes: those without a printable sign of their own follow upon 255.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SPACE_SIGN = chr(BYTE_SIGNS[32])
#: Bytes of ids that one batch hands to the writer, about.
BATCH_BYTES = 2 << 20
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole texts by the distinct pieces of a chunk of them; ids are those of the tokenizer over each whole text.

    A byte-level tokenizer takes a space together with what stands behind it,
    unless that is white space too, so the text before such a space and the
    text from it on have ids of their own. Letters, the ASCII signs behind
    them, and single line ends between words, likewise. A text that spells out
    an added token, or has white space behind a space, is encoded in one go, as
    is every text where the tokenizer is not of this kind.
    """

    def __init__(self, path: str):
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.merges = self.model.model
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        made = json.loads(self.model.to_str())
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        splits = made["pre_tokenizer"] or {}
        self.by_pieces = (
            splits.get("type") == "ByteLevel" and not splits["add_prefix_space"] and splits["use_regex"] and not made["normalizer"] and not made["truncation"] and not made["padding"]
            and made["model"]["type"] == "BPE" and all((made["model"].get(k) or v) == v for k, v in plain.items())
        )
        # What is remembered: units and their ids.
        self.known, self.known_ids = pa.array([], pa.string()), _lists([])

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _merged(self, units: list[str]) -> list[list[int]]:
        """The ids of units: words, with the space before them or without, signs, or a line end; the tokenizer does not part these further before it merges."""
        out, tokenize = [], self.merges.tokenize
        for unit in units:
            if unit.isascii() and unit.isalnum():
                signs = unit
            elif unit.isascii() and unit[:1] == " ":
                signs = SPACE_SIGN + unit[1:]
            else:
                signs = unit.encode().decode("latin-1").translate(BYTE_SIGNS)
            out.append([x.id for x in tokenize(signs)] if signs else [])
        return out

    def _remember(self, pieces: pa.Array, ids: pa.Array, often: np.ndarray, asked: np.ndarray) -> None:
        """Takes in fresh units; beyond MEMORY_BYTES only what the chunk has more than once, and of the known ones what it asked for."""
        if self.known.nbytes + self.known_ids.nbytes + pieces.nbytes + ids.nbytes > MEMORY_BYTES:
            kept, seen = pa.array(np.unique(asked)), pa.array(often)
            self.known, self.known_ids, pieces, ids = pc.take(self.known, kept), pc.take(self.known_ids, kept), pieces.filter(seen), ids.filter(seen)
            if self.known.nbytes + self.known_ids.nbytes + pieces.nbytes + ids.nbytes > MEMORY_BYTES:
                self.known, self.known_ids = self.known[:0], self.known_ids[:0]
        if pieces.nbytes + ids.nbytes <= MEMORY_BYTES:
            self.known, self.known_ids = pa.concat_arrays([self.known, pieces]), pa.concat_arrays([self.known_ids, ids])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and the ids of all, with end_id behind each text; null is empty."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and looking for it again and again takes a third of the time
        try:
            return self._encode(pc.fill_null(texts, ""), end_id)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_pieces or not len(texts):
            out = _lists([[*self._ids(x.as_py()), end_id] for x in texts])
            return np.diff(out.offsets.to_numpy()).astype(np.int64), out.values.to_numpy()
        parts = pc.split_pattern(texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        values = parts.flatten()
        coded, first = values.dictionary_encode(), pc.take(values, pa.array(at[:-1])).dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        table, others, units, n_units, joined = _units_of(coded.dictionary)
        # The rows of ids: known units, fresh ones, other pieces, first pieces of texts (no space before them), the end, and whole texts.
        known = pc.index_in(table, value_set=self.known)
        is_new = pc.is_null(known).to_numpy(zero_copy_only=False)
        fresh = table.filter(pa.array(is_new))
        made = self._merged(fresh.to_pylist())
        base = len(self.known_ids)
        more = made + [self._ids(x) for x in others] + [self._ids(x) if x else [] for x in first.dictionary.to_pylist()] + [[end_id]]
        place = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        place[is_new] = base + np.arange(len(made))
        place = np.concatenate([place, base + len(made) + np.arange(len(others))])
        # The rows of units: pieces, first pieces, the end, nothing, and whole texts.
        single = base + len(made) + len(others) + np.arange(len(first.dictionary) + 1)
        end = len(n_units) + len(first.dictionary)
        index[at[:-1]] = len(n_units) + first.indices.to_numpy()
        rows, sizes = [place[units], single], [n_units, np.ones(len(single), np.int64), [0]]
        whole = np.logical_or.reduceat(np.append(joined, np.zeros(len(single), bool))[index], at[:-1])
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        alone = np.flatnonzero(whole)
        for j, k in enumerate(alone.tolist()):
            index[at[k] : at[k + 1]] = end + 1
            index[at[k]] = end + 2 + j
            more.append(self._ids(texts[k].as_py()))
        rows.append(single[-1] + 1 + np.arange(len(alone)))
        sizes.append(np.ones(len(alone), np.int64))
        upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        pieces = pc.take(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(rows))), pa.array(np.insert(index, at[1:], end)))
        lists = pa.concat_arrays([self.known_ids, _lists(more)])
        out = pc.take(lists, pieces.values)
        ends = np.append(at[:-1] + np.arange(len(texts)), len(pieces))
        upto = out.offsets.to_numpy()[pieces.offsets.to_numpy()[ends]]
        used = np.bincount(units, np.repeat(np.bincount(coded.indices.to_numpy(), minlength=len(n_units)), n_units), len(table))[: len(table)]
        self._remember(fresh, lists[base : base + len(made)], used[is_new] > 1, place[: len(table)][~is_new])
        return np.diff(upto).astype(np.int64), out.values.to_numpy()


def _units_of(pieces: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """What pieces with a space before them consist of: a table of units, other pieces (with the space) that are to be encoded whole,
    the units of all pieces in a row (places in table and others), their numbers, and the pieces that the tokenizer may join with the space before."""
    lines = pc.split_pattern(pieces, "\n")
    n_lines = np.diff(lines.offsets.to_numpy()).astype(np.int64)
    subs = lines.flatten()
    heads = pc.utf8_rtrim(subs, characters=string.punctuation)
    begins = np.cumsum(n_lines) - n_lines
    good = np.logical_and.reduceat(pc.utf8_is_alpha(heads).to_numpy(zero_copy_only=False), begins)
    kept = np.repeat(good, n_lines)
    leads = np.zeros(len(subs), bool)
    leads[begins] = True
    leads = leads[kept]
    subs, heads = subs.filter(pa.array(kept)), heads.filter(pa.array(kept))
    spaces = pa.DictionaryArray.from_arrays(pa.array(np.where(leads, 0, 1), pa.int8()), pa.array([" ", ""])).cast(pa.string())
    length = pc.binary_length(heads).to_numpy().astype(np.int64)
    n_signs = pc.binary_length(subs).to_numpy().astype(np.int64) - length
    coded = pa.concat_arrays([pc.binary_join_element_wise(spaces, heads, ""), _slices(subs, length, n_signs), pa.array(["\n"])]).dictionary_encode()
    code, m = coded.indices.to_numpy().astype(np.int64), len(subs)
    each = np.stack([np.where(leads, -1, code[-1]), code[:m], np.where(n_signs > 0, code[m : 2 * m], -1)], 1)
    rows = np.flatnonzero(good)
    of_piece = np.repeat(np.arange(len(rows)), n_lines[good])
    n_units = np.zeros(len(pieces), np.int64)
    n_units[rows] = np.bincount(of_piece, (each >= 0).sum(1), len(rows)).astype(np.int64)
    others, joined = [], np.zeros(len(pieces), bool)
    for k in np.flatnonzero(~good).tolist():
        piece = pieces[k].as_py()
        if not piece or piece[0].isspace():
            joined[k] = True
        else:
            n_units[k] = 1
            others.append(" " + piece)
    units = np.empty(n_units.sum(), np.int64)
    of_good = np.repeat(good, n_units)
    units[of_good] = each[each >= 0]
    units[~of_good] = len(coded.dictionary) + np.arange(len(others))
    return coded.dictionary, others, units, n_units, joined


def _slices(values: pa.Array, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """Of each string the bytes from `begin` on."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    upto = np.cumsum(length)
    take = np.repeat(at[:-1] + begin - (upto - length), length) + np.arange(length.sum())
    data = np.frombuffer(values.buffers()[2], np.uint8)[take] if len(take) else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32)), pa.py_buffer(data))


def _lists(ids: list[list[int]]) -> pa.Array:
    at = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, at[-1])))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (its last column the texts) of about CHUNK_BYTES of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False))
    begin, upto = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, upto + CHUNK_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin, upto = end, int(sizes[end - 1])


def _encode(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in _chunks(batch):
                n, ids = coder.encode(part.column(1), end_id)
                upto = np.concatenate([[0], np.cumsum(n)])
                begin = 0
                while begin < len(n):  # small batches: the writer takes each as a whole
                    end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + BATCH_BYTES // 4, side="right")) - 1)
                    tokens = pa.ListArray.from_arrays(pa.array(upto[begin : end + 1] - upto[begin], pa.int32()), pa.array(ids[upto[begin] : upto[end]].view("<i4")))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(begin, end - begin), pa.array(n[begin:end]), tokens], schema=schema)
                    begin = end
                pa.default_memory_pool().release_unused()

    return run


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every row of `docs` (doc_id, text) and return the table of files: seq, doc_id, n_tokens, tokens.

    path: where to (else a new folder of the shared one). tokenizer: the
    vocabulary file, found under the same path on every machine. Each document
    ends with end_id; null texts are empty. Rows with equal doc_id lie by the
    hash of their text; a null doc_id comes first. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    placed = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    encoded = placed.mapInArrow(releasing(_encode(tokenizer or tokenizer_path(), end_id)), "doc_id long, n_tokens long, tokens array<int>")
    out = encoded.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "n_tokens", "tokens")
    options = {
        "compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#seq": "false", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    if path is None:
        return durable(out, "tokens", **options)
    out.write.options(**options).mode("overwrite").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`rows` (seq, n_tokens and others) with start, the number of ids of all rows of `files` before.

    The counts by range, one row for each task that wrote, give where a range
    begins; within one, rows add up in order.
    """
    part = F.shiftright("seq", 33)
    parts = files.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    rows = rows.withColumn("part", part).withColumn("within", within).join(F.broadcast(base), "part")
    return rows.withColumn("start", F.col("base") + F.col("within")).drop("part", "base", "within")


def places(files: DataFrame) -> DataFrame:
    """seq, doc_id, n_tokens and start; reads no ids."""
    return _placed(files.select("seq", "doc_id", "n_tokens"), files)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(ids[a:b]) for a, b in itertools.pairwise(at.tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["seq", "doc_id", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, by one pass over the files and one over their counts."""
    rows = files.select("seq", "doc_id", "n_tokens", "tokens").mapInArrow(releasing(_checksums), "seq long, doc_id long, n_tokens long, ids_crc32 long")
    return _placed(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_tokens(files: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of `files` with doc_id from first to last; row groups and pages without any are not read."""
    return files.filter(F.col("doc_id").between(first, last))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; null and empty texts have the end id alone, repeated rows places of their own."""
    return read_digests(write_tokens(table(spark, sf_dir, "documents")))


QUERIES = {"op7_token_files": op7_token_files}
ORACLE: dict[str, str] = {}
