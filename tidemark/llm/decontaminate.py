"""Benchmark decontamination with an FM-index over each shard of the training texts.

A shard is a run of words of documents that one task holds at a time. All its
words become symbols, the places of their 64-bit hashes among the shard's; a
zero ends each document. The suffix array gives the Burrows-Wheeler transform;
a wavelet matrix over it answers ranks; all windows of the benchmark are
searched backwards at once; and their occurrences are located by stepping to
suffix positions that were sampled (every eighth, and every document's first).
Spans that overlap are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.shingles import LOWER, word_stream
from tidemark.llm.tables import releasing, small_batches, table
from tidemark.session import durable

WINDOW_WORDS = 10
#: Words of a shard, about. A document of more is cut into shards that overlap by a window.
SHARD_WORDS = 1 << 18
#: Bytes of benchmark text that are broadcast at once, about; a larger benchmark is searched in blocks, one pass for each.
BLOCK_BYTES = 4 << 20
#: Hits of a larger benchmark that are broadcast to the documents; beyond, both sides are shuffled.
BROADCAST_HITS = 200_000
SAMPLED = 8
#: A-Z to a-z, and each byte of [\x00-\x2F\x3A-\x60\x7B-\x7F], which part words, once A-Z are a-z.
PARTS = np.zeros(256, bool)
PARTS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
SPACED = bytes(32 if p else b for b, p in enumerate(PARTS))
SPANS = "array<struct<first:int,last:int>>"
STATE = f"n_words long, spans {SPANS}, items array<string>"


class Windows:
    """The windows of a block of items: the hashes of all words in a row, and of each window its first word, length and item."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.size = size
        self.names = [name for name, _ in items]
        words = list(word_stream([text for _, text in items], LOWER, PARTS))
        n = np.array([len(w) for w in words], np.int64)
        self.hashes = np.concatenate([*words, np.zeros(0, np.uint64)])
        many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        self.item = np.repeat(np.arange(len(items)), many)
        self.first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(n) - n, many)
        self.length = np.repeat(np.minimum(n, size), many)

    def patterns(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows all of whose words are among the sorted hashes `known`, and their symbols (places from 1 there), right-aligned: the last is searched first."""
        at = np.minimum(np.searchsorted(known, self.hashes), max(len(known) - 1, 0))
        symbol = np.where(known[at] == self.hashes, at + 1, 0) if len(known) else np.zeros(len(self.hashes), np.int64)
        absent = np.concatenate([[0], np.cumsum(symbol == 0)])
        sought = np.flatnonzero(absent[self.first + self.length] == absent[self.first])
        out = np.zeros((len(sought), self.size), np.int32)
        for k in range(self.size):  # the k-th last
            has = self.length[sought] > k
            out[has, self.size - 1 - k] = symbol[(self.first + self.length)[sought[has]] - 1 - k]
        return sought, out


def words(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z as a-z."""
    return (text or b"").translate(LOWER).translate(SPACED).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling, over what is not yet apart; the zeros that end documents differ from each other, so these bound the rounds."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text + zeros.sum()).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of equals
    open_ = _open(new)
    while len(open_):
        at = order[open_]
        after = np.zeros(len(at), np.int64)
        inside = at + step < n
        after[inside] = rank[at[inside] + step] + 1
        key = rank[at] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[_open(new)]
        step *= 2
    return order


def _open(new: np.ndarray) -> np.ndarray:
    """Places in runs of more than one equal, given where runs begin."""
    return np.flatnonzero(~new | ~np.append(new[1:], True))


class WaveletMatrix:
    def __init__(self, text: np.ndarray, width: int):
        self.levels = []
        for bit in range(max(width - 1, 1).bit_length() - 1, -1, -1):
            ones = ((text >> bit) & 1).astype(bool)
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            self.levels.append((bit, before, len(text) - int(before[-1])))
            text = np.concatenate([text[~ones], text[ones]])
        first = np.zeros(width, np.int64)
        values, at = np.unique(text, return_index=True)
        first[values] = at  # where each symbol's rows begin on the last level
        self.first = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for bit, before, zeros in self.levels:
            ones = before[at]
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at - self.first[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = (before[at + 1] - before[at]).astype(np.int64)
            out |= one << bit
            at = np.where(one == 1, zeros + before[at], at - before[at])
        return out


class FMIndex:
    """Over symbols from 1 and zeros that end each document; no pattern has a zero."""

    def __init__(self, text: np.ndarray, width: int):
        order = suffix_array(text)
        self.matrix = WaveletMatrix(text[order - 1], width)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=width))])
        begins = np.concatenate([[True], text[:-1] == 0])
        self.sampled = (order % SAMPLED == 0) | begins[order] | (text[order] == 0)
        self.samples = order[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.size = len(text)

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffix array that begin with each right-aligned pattern: first and end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            live = live[(length[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - k]
            low[live] = self.less[c] + self.matrix.rank(c, low[live])
            high[live] = self.less[c] + self.matrix.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, steps, live = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(live):
            hit = self.sampled[row[live]]
            done = live[hit]
            out[done] = self.samples[self.sample_rank[row[done]]] + steps
            live = live[~hit]
            c = self.matrix.access(row[live])
            row[live] = self.less[c] + self.matrix.rank(c, row[live])
            steps += 1
        return out


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Spans (first, last) without those that overlap or touch, in order."""
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order])
    begins = np.flatnonzero(np.concatenate([[True], first[1:] > upto[:-1] + 1])) if len(first) else np.zeros(0, np.int64)
    return list(zip(first[begins].tolist(), upto[np.append(begins[1:], len(first)) - 1].tolist(), strict=True))


class Shard:
    """Words of documents, in parts: the document, and which word of it a part begins with."""

    def __init__(self):
        self.parts: list[tuple[int, int, np.ndarray]] = []
        self.size = 0

    def put(self, doc: int, begin: int, words: np.ndarray) -> None:
        self.parts.append((doc, begin, words))
        self.size += len(words)

    def search(self, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each document with hits: its place, first and last words of the hits, and the items of their windows."""
        if not self.size or not len(windows.first):
            return
        known, places = np.unique(np.concatenate([w for _, _, w in self.parts]), return_inverse=True)
        sought, patterns = windows.patterns(known)
        if not len(sought):
            return
        ends = np.cumsum([len(w) for _, _, w in self.parts])
        text = np.insert(places.astype(np.int64) + 1, ends, 0)
        index = FMIndex(text, len(known) + 1)
        length = windows.length[sought]
        low, high = index.search(patterns, length)
        many = high - low
        found = np.flatnonzero(many)
        if not len(found):
            return
        many = many[found]
        which = np.repeat(found, many)
        place = index.locate(np.repeat(low[found] - (np.cumsum(many) - many), many) + np.arange(many.sum()))
        begins = ends - np.array([len(w) for _, _, w in self.parts]) + np.arange(len(self.parts))
        part = np.searchsorted(begins, place, side="right") - 1
        doc = np.array([d for d, _, _ in self.parts])[part]
        first = np.array([b for _, b, _ in self.parts])[part] + place - begins[part]
        order = np.argsort(doc, kind="stable")
        doc, first, which = doc[order], first[order], which[order]
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
            yield int(doc[a]), first[a:b], first[a:b] + length[which[a:b]] - 1, np.unique(windows.item[sought[which[a:b]]])


def search_texts(texts: list[bytes | None], windows: Windows, size: int) -> tuple[list[int], dict[int, list[tuple[int, int]]], dict[int, list[str]]]:
    """Of each text its number of words; of those with hits the merged spans of words, and the sorted items that have the windows."""
    n_words: list[int] = []
    hits: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    shard = Shard()

    def close() -> Shard:
        for doc, first, last, item in shard.search(windows):
            hits.setdefault(doc, []).append((first, last, item))
        return Shard()

    for doc, hashes in enumerate(word_stream(texts, LOWER, PARTS)):
        n_words.append(len(hashes))
        for begin in range(0, max(1, len(hashes) - size + 1) if len(hashes) else 0, SHARD_WORDS):
            shard.put(doc, begin, hashes[begin : begin + SHARD_WORDS + size - 1])
            if shard.size >= SHARD_WORDS:
                shard = close()
    close()
    spans = {doc: _merged(*(np.concatenate(x) for x in list(zip(*found, strict=True))[:2])) for doc, found in hits.items()}
    items = {doc: sorted({windows.names[k] for _, _, item in found for k in item}) for doc, found in hits.items()}
    return n_words, spans, items


def _search(block, size: int, cut: bool):
    """Adds n_words, spans and items to row and text. cut: the words of the spans go, and rows of which none is left."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block.value, size)
        for batch in batches:
            n_words, spans, items = search_texts([x.as_py() for x in batch.column(1)], windows, size)
            found = [[{"first": a, "last": b} for a, b in spans.get(k, ())] for k in range(batch.num_rows)]
            state = [pa.array(n_words, pa.int64()), pa.array(found, span), pa.array([items.get(k, []) for k in range(batch.num_rows)], pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*batch.columns, *state], ["row", "text", "n_words", "spans", "items"])
            yield from _cut([out]) if cut else [out]

    return releasing(run)


def _place_words(text: bytes) -> np.ndarray:
    """The ends of the words of a text."""
    inside = ~PARTS[np.frombuffer(text.translate(LOWER), np.uint8)]
    return np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1


def without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """`text` without the words of `spans` (ascending, apart) and without what stands before each of these words."""
    ends = np.concatenate([[0], _place_words(text)])
    out, at = [], 0
    for s in spans:
        out.append(text[at : ends[s["first"]]])
        at = ends[s["last"] + 1]
    return b"".join([*out, text[at:]])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(3).to_pylist()
        left = [n is None or n == 0 or sum(x["last"] - x["first"] + 1 for x in s) < n for n, s in zip(batch.column(2).to_pylist(), spans, strict=True)]
        texts = [without(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column(1), spans, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]], batch.schema.names).filter(pa.array(left))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row in order, without those that overlap or touch, and its items once; columns: _id, spans, items."""
    for batch in batches:
        spans, items = [], []
        for s, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            merged = _merged(np.array([x["first"] for x in s]), np.array([x["last"] for x in s]))
            spans.append([{"first": a, "last": b} for a, b in merged])
            items.append(sorted(set(i)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.column(1).type), pa.array(items, pa.list_(pa.string()))], ["_id", "spans", "items"])


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, cut: bool = False) -> DataFrame:
    """row (the columns of `docs` but the text), text, n_words, spans and items; cut: the text without the spans' words, and no row of which none is left.

    The first block is searched in the pass that hands the documents on. Of a
    larger benchmark the result is written, and then the hits of each further
    block, which join it by row in the end; so the driver and a task hold one
    block at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text")).filter("length(text) > 0")
    total = bench.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = int(total // block_bytes) + 1

    def searched(rows: DataFrame, k: int) -> DataFrame:
        part = bench.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        block = spark.sparkContext.broadcast([(r["id"], bytes(r["text"])) for r in part.collect()])
        kind = rows.schema["row"].dataType.simpleString()
        return rows.mapInArrow(_search(block, window, cut and blocks == 1), f"row {kind}, text binary, {STATE}")

    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("binary").alias("text"))
    out = searched(rows, 0)
    if blocks > 1:
        out = durable(out.withColumn("_id", F.monotonically_increasing_id()), "searched")
        hits = out.filter("size(spans) > 0").select("_id", "spans", "items")
        for k in range(1, blocks):
            got = searched(out.select(F.struct("_id").alias("row"), "text"), k).filter("size(spans) > 0")
            hits = hits.union(durable(got.select("row._id", "spans", "items"), "hits"))
        hits = hits.groupBy("_id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        hits = durable(hits.mapInArrow(releasing(_joined), f"_id long, spans {SPANS}, items array<string>"), "hits").toDF("_id", "s", "i")
        out = out.join(F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits, "_id", "left")
        out = out.select("row", "text", "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"))
        if cut:
            out = out.mapInArrow(releasing(_cut), f"row {rows.schema['row'].dataType.simpleString()}, text binary, {STATE}")
    return out.select("row", F.col("text").cast("string").alias("text"), "n_words", "spans", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans and items of every row of `docs` (doc_id, text).

    spans: merged runs of words (first and last index) inside any occurrence of
    a window of `window` consecutive words of an item of `benchmark` (item_id,
    text); an item of fewer words, but not none, is one window. items: the ids,
    as sorted distinct strings, of the items with windows that occur. Null and
    empty texts have no words. Rows of the benchmark without an id take part
    under the empty id. A benchmark above `block_bytes` is searched in blocks of
    about that size, each in a pass of its own. Words are compared by 64-bit
    hashes. Repeated rows each come back; other columns are ignored.
    """
    return _found(docs.select("doc_id", "text"), benchmark, window, block_bytes).select("row.doc_id", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` with the words of their spans cut out of the text, along with what stands before each; n_chars, if there is one, follows.

    All else of the text stays as it is. Rows of which no word is left go.
    """
    left = _found(docs, benchmark, window, block_bytes, cut=True)
    n_chars = lambda c: F.when(F.size("spans") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`"))
    columns = {c: F.col("text") if c == "text" else n_chars(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns}
    return left.select(*[v.alias(c) for c, v in columns.items()])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents; null and empty texts have no words and no hits."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM d, sizes WHERE len(w) >= n
), hits AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.s = v.s AND p.n = v.n
), covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE = {"op3_decontaminate": SQL}
