"""Runs: stretches of words that repeat with a period, four times or more.

Each text becomes a sequence of word numbers. For every scale b = 1, 2, 4, ...
its aligned blocks of b words are the keys of an automaton over integer
sequences, which the whole sequence is searched with. A run of period q, b <= q
< 2b, and of four periods holds an aligned block that stands again q words
later, so each occurrence at a distance from b to 2b behind its block seeds an
exact extension to both sides: as far as words q apart are identical. A block
is written as the names of its halves, exact numbers that double from scale to
scale, so keys have two numbers at any scale, and the automaton stays small.

Words that occur fewer than four times in their stretch lie in no run; they cut
the sequence before the search, again and again until none is left.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.tables import releasing, small_batches, table

#: A run has this many periods and this many words at least.
PERIODS, LEAST = 4, 6


def _cut(z: np.ndarray) -> np.ndarray:
    """Places of the words of `z` (0: no word) that occur PERIODS times or more within their stretch of such words."""
    at = np.flatnonzero(z)
    while len(at):
        stretch = np.cumsum(np.concatenate([[0], np.diff(at) > 1]))
        code = pa.array(stretch * (int(z.max()) + 1) + z[at]).dictionary_encode().indices.to_numpy()
        often = np.bincount(code)[code] >= PERIODS
        often &= (np.bincount(stretch) >= LEAST)[stretch]
        if often.all():
            break
        at = at[often]
    return at


def _seeds(y: np.ndarray, b: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The aligned blocks of b words and their occurrences b to 2b - 1 places later: where the blocks begin, where the occurrences do.

    `y` has names of the m words at each place (0: none), m = b / 2, or 1 where
    b is. A key is the names of a block; the sequence takes every m-th place,
    from place 0, then from place 1, and so on.
    """
    n = -(-len(y) // b)
    laid = np.concatenate([y, np.zeros((n + 1) * b - len(y), np.int64)])
    pairs = laid[: n * b].reshape(n, b)[:, [0, m]] if b > 1 else np.stack([y, y], 1)
    whole = np.flatnonzero((pairs > 0).all(1))
    coded = pa.array(pairs[whole, 0] * (int(y.max()) + 1) + pairs[whole, 1]).dictionary_encode()
    number = np.full(n + 2, -1)
    number[whole] = coded.indices.to_numpy()
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, j in enumerate(whole[np.unique(number[whole], return_index=True)[1]].tolist()):
        found.add_word(tuple(pairs[j].tolist()[: min(b, 2)]), k)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found.make_automaton()
    laid = laid.reshape(-1, m)
    hits = np.fromiter(itertools.chain.from_iterable(found.iter(tuple(laid.T.ravel().tolist()))), np.int64).reshape(-1, 2)
    residue, row = np.divmod(hits[:, 0], len(laid))
    begin = row * m + residue - (b - m)
    block = begin // b - 1  # the one aligned block that begins b to 2b - 1 places before
    ok = np.flatnonzero((block >= 0) & (number[block] == hits[:, 1]))
    ok = ok[np.argsort(begin[ok])]
    return block[ok] * b, begin[ok]


def _doubled(name: np.ndarray, m: int) -> np.ndarray:
    """Names of the 2m words at each place from those of m words; 0 where fewer are named, or where the words are found less often than any in a run of 4m words a period."""
    at = np.flatnonzero(name[:-m])
    at = at[name[at + m] > 0]
    code = pa.array(name[at] * (int(name.max()) + 1) + name[at + m]).dictionary_encode().indices.to_numpy().astype(np.int64)
    often = np.bincount(code)[code] >= PERIODS - 1
    out = np.zeros_like(name)
    out[at[often]] = code[often] + 1
    return out


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many first values of a and b are equal words, looking at ever longer pieces."""
    upto, step, n = 0, 64, min(len(a), len(b))
    while upto < n:
        x, y = a[upto : min(upto + step, n)], b[upto : min(upto + step, n)]
        other = (x != y) | (x == 0)
        if other.any():
            return upto + int(other.argmax())
        upto, step = upto + len(x), step * 2
    return n


def _is_smallest(z: np.ndarray, begin: int, period: int) -> bool:
    """Whether the run of `period` at `begin` has no smaller one; that would divide it, as the run is longer than two periods."""
    rest, r = period, 2
    while rest > 1:
        r = r if r * r <= rest else rest
        if rest % r == 0:
            p = period // r
            if np.array_equal(z[begin : begin + period], z[begin + p : begin + p + period]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def runs_of(z: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of `z`, numbers of words, with 0 before, behind and between texts; by start, then period."""
    name = np.zeros(len(z), np.int64)
    at = _cut(z)
    name[at] = z[at]
    period, end = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)  # of the run found last at a place
    runs, b, m = [], 1, 1
    while len(at := np.flatnonzero(name)):
        begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        sizes = np.diff(np.append(begins, len(at)))
        long = sizes > PERIODS * b - m
        at, sizes = at[np.repeat(long, sizes)], sizes[long]
        if not len(at):
            break
        gaps = np.repeat(np.cumsum(sizes) - sizes, m)  # nothing for m places before each stretch
        y, where = np.insert(name[at], gaps, 0), np.insert(at, gaps, -1)
        first, later = _seeds(y, b, m)
        first, distance = where[first], later - first
        inside = (period[first] > 0) & (distance % np.maximum(period[first], 1) == 0) & (first + distance + b <= end[first])
        done: dict[int, int] = {}  # by distance, how far its last stretch reaches
        for i, d in zip(first[~inside].tolist(), distance[~inside].tolist(), strict=True):
            if i < done.get(d, 0):
                continue
            begin = i - _reach(z[:i][::-1], z[: i + d][::-1])
            done[d] = i + _reach(z[i:], z[i + d :])
            length = done[d] + d - begin
            if length >= max(LEAST, PERIODS * d) and _is_smallest(z, begin, d):
                runs.append((begin, length, d))
                period[begin : begin + length], end[begin : begin + length] = d, begin + length
        if b > 1:
            name, m = _doubled(name, m), b
        b *= 2
    return np.array(sorted(set(runs), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_texts = batch.num_rows
        lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
        words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        some = pc.greater(pc.binary_length(words), 0)
        words, owner = words.filter(some).dictionary_encode(), owner[some.to_numpy(zero_copy_only=False)]
        n_words = np.bincount(owner, minlength=n_texts)
        base = np.cumsum(n_words) - n_words
        # In z a 0 stands before each text and behind the last.
        z = np.zeros(len(words) + n_texts + 1, np.int64)
        place = np.arange(len(words)) + owner + 1
        z[place] = words.indices.to_numpy().astype(np.int64) + 1
        runs = runs_of(z)
        zeros = base + np.arange(n_texts)
        of = np.searchsorted(zeros, runs[:, 0]) - 1
        starts = runs[:, 0] - zeros[of] - 1
        deeper = np.zeros(len(z) + 1, np.int64)
        np.add.at(deeper, runs[:, 0] + runs[:, 2], 1)
        np.add.at(deeper, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(deeper)[place] == 0
        n_kept, n_runs = np.bincount(owner[kept], minlength=n_texts), np.bincount(of, minlength=n_texts)
        left = pa.ListArray.from_arrays(_offsets(n_kept), words.filter(pa.array(kept)).dictionary_decode())
        found = pa.StructArray.from_arrays([pa.array(starts), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUNS.value_type))
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(_offsets(n_runs), found), pc.binary_join(left, " ")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of `docs` (doc_id, text).

    Words are what ASCII white space parts in the whole text. runs: each
    stretch of LEAST words and PERIODS periods or more that no neighbour
    extends, as (start, length, period) with the smallest period, by start and
    period. collapsed: the text without the words of a run behind its first
    period, joined by single spaces. Null and empty texts have no words and no
    runs and collapse to an empty text; repeated rows stay; other columns are
    ignored. A task holds one batch of ARROW_BYTES, or one longer text.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(releasing(_find), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of `docs`, a tenth of them with a tail that repeats: of those whose crc32 of the decimal doc_id, h, ends in 0.

    With n words and g = h div 10, words from a = g mod n on repeat with period
    1 + (n - a) div (3 + g mod 8). A null doc_id has no h: such texts stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), (h % 10 == 0).alias("_hit"))
    rows = rows.withColumn("_w", F.when(F.col("_hit"), words)).withColumn("_a", F.expr("CASE WHEN size(_w) > 0 THEN _g % size(_w) END"))
    rows = rows.withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)"))
    tail = F.expr("array_join(transform(_w, (w, i) -> CASE WHEN i < _a THEN w ELSE _w[int(_a + (i - _a) % _p)] END), ' ')")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the one of greatest length (then least start, then period), and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))

    out = found.withColumn("_r", longest)
    length, period = F.col("_r.length"), -F.col("_r.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_r.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _r.length div -_r.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, with the planted tails; null and empty texts have no runs and the digests of empty texts, repeated rows are found each for itself."""
    return digest(find_runs(planted(table(spark, sf_dir, "documents"))))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE: dict[str, str] = {}
