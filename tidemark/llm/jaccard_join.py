"""N-gram Jaccard join by parity sketches.

Every shingle toggles one bit of a document's sketch, so the Hamming distance
of two sketches never exceeds the symmetric difference of the shingle sets.
The sketch is kept sparse: it falls into 2**level blocks, and each block is
the XOR of the hashes of its shingles. Sizes are cut into bands, one for each
level. Two sets of a and b shingles at a Jaccard similarity of p percent
differ in at most (100 - p) * (a + b) / (100 + p) shingles, each of which
changes one block. By the pigeonhole principle, in any order of block contents
common to all documents, the first `difference + 1` blocks of either set hold
one block on which both agree. That order puts blocks with many rare shingles
first, so passages that many documents share seldom make candidates; the list
of frequent shingles changes the work, never the result.

Sets that agree on a block are candidates, and shingle sets verify them.
Documents of equal sets are one class throughout. Where a block is common to
many classes, each is held against the least class first; only what is then
still in different components is held against each other, by dense sketches
whose distance rules out nearly all that do not link. In blocks of many classes
each is first held only against the nearest outside its component, which joins
most of them; what is left is held against each other in tiles. So no two
documents that link end in different components. Links between classes that
others already join are not listed, and within a block only sets that are near
by their sketches and still apart are verified pair by pair.

Equality of shingles, sets and blocks is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.components import components
from tidemark.llm.shingles import mix, shingle_sets
from tidemark.llm.tables import releasing, shuffle_partitions, small_batches, table
from tidemark.session import durable

THRESHOLD = 80
#: Bound of the broadcast list of frequent shingles, 8 bytes each.
FREQUENT = 1 << 16
#: Block keys that one bucket holds, about; 16 bytes each.
BUCKET_KEYS = 1 << 19
#: Block keys that are gathered, and combined, before they are handed to the shuffle.
FLUSH_KEYS = 1 << 19
#: Sets that a task remembers so as to send the blocks of equal ones once; 8 bytes each and what holds them.
SEEN = 200_000
#: Bits of a dense sketch for each block of the sparse one.
SKETCH_BITS = 4
#: Most ids of documents that are broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Classes of a block that are held against each other at once, of either side.
TILE = 4096
#: Classes up to which a block is held against itself at once.
SMALL = 64
_PAIR = "a long, b long"


def largest_partner(n: int, percent: int) -> int:
    """The largest set that can reach `percent` with one of n shingles."""
    return 100 * n // percent


def most_differences(n: int, percent: int) -> int:
    """The most shingles in which a set of n and any partner can differ."""
    return (100 - percent) * (n + largest_partner(n, percent)) // (100 + percent)


def level(n: int, percent: int) -> int:
    """The band of a set of n shingles; its sketch has 2**level blocks, over twice the differences."""
    return max(4, (2 * most_differences(n, percent)).bit_length())


def set_signature(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def block_keys(shingles: np.ndarray, frequent: np.ndarray, percent: int = THRESHOLD) -> np.ndarray:
    """The keys of the first `most_differences + 1` blocks, for each band in which a partner may be."""
    n = len(shingles)
    need = most_differences(n, percent) + 1
    if n == 0 or need == 1 and most_differences(largest_partner(n, percent), percent) == 0:
        return np.zeros(0, np.uint64)  # only equal sets link
    rare = np.ones(n, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rare = frequent[at] != shingles
    toggles = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    out = []
    for lv in sorted({level(n, percent), level(largest_partner(n, percent), percent)}):
        block = shingles >> np.uint64(64 - lv)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        content, score = np.bitwise_xor.reduceat(toggles, first), np.add.reduceat(rare.astype(np.uint64), first)
        keys = _keys(block[first], content, np.minimum(score + np.uint64(1), np.uint64(15)), lv)
        if len(keys) < need:
            empty = np.setdiff1d(np.arange(1 << lv, dtype=np.uint64), block[first])
            keys = np.concatenate([keys, _keys(empty, np.zeros(len(empty), np.uint64), np.zeros(len(empty), np.uint64), lv)])
        out.append(np.partition(keys, len(keys) - need)[len(keys) - need :] if len(keys) > need else keys)
    return np.concatenate(out)


def _keys(block: np.ndarray, content: np.ndarray, score: np.ndarray, lv: int) -> np.ndarray:
    """Order and identity of a block in one number: 4 bits of score over 60 of a hash."""
    return (score << np.uint64(60)) | (mix(content ^ mix(block + np.uint64(lv << 40))) >> np.uint64(4))


def _batches(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: doc_id, text_hash, n, sig of each row. kind 1: a count n of a shingle sig that is frequent near here."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sig", pa.int64())])
    for batch in batches:
        ids, counts, sigs, gathered, size = batch.column(0), [], [], [], 0
        common: list[tuple[np.ndarray, np.ndarray]] = []
        for s in shingle_sets(batch.column(2).to_pylist()):
            counts.append(len(s))
            sigs.append(set_signature(s) if len(s) else None)
            gathered.append(s)
            size += len(s)
            if size > 200_000:
                common.append(_commonest(gathered))
                gathered, size = [], 0
        if gathered:
            common.append(_commonest(gathered))
        yield _batches({"kind": [0] * len(counts), "doc_id": ids, "text_hash": batch.column(1), "n": counts, "sig": sigs}, schema)
        for values, n in common:
            if len(values):
                yield _batches({"kind": [1] * len(values), "doc_id": [None] * len(values), "text_hash": [None] * len(values), "n": n, "sig": values.view(np.int64)}, schema)


def _commonest(sets: list[np.ndarray], least: int = 4, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    keep = np.flatnonzero(n >= least)
    keep = keep[np.argsort(-n[keep], kind="stable")[:most]]
    return values[keep], n[keep]


def _emit_blocks(frequent, buckets: int, percent: int):
    """Block keys with their classes, by bucket. Where a flush has over two classes of a block, they are combined here: only
    the least goes to the block's bucket, with the number of their set, and the set itself goes to a bucket of its own, above
    `buckets`. So a block in any number of documents brings its bucket at most two classes for each flush."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sigs", pa.binary()), ("sets", pa.binary())])

    def flush(keys: list[np.ndarray], sigs: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.array(sigs, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first, size, number = _runs(key, owner)
        many = size > 2
        apart = ~np.repeat(many, size)
        rows = _by_bucket(key[apart], owner[apart], None, buckets) + _by_bucket(key[first[many]], owner[first[many]], number[many], buckets)
        _, once = np.unique(number[many], return_index=True)
        first, size, number = first[many][once], size[many][once], number[many][once]
        if len(first):
            rows.append((buckets + int(number[0] % np.uint64(buckets)), np.repeat(number, size).tobytes(), owner[_members(first, size)].tobytes(), b""))
        return _batches(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, sigs, size = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist()):
                if not len(s) or (sig := set_signature(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sig)
                if len(k := block_keys(s, frequent.value, percent)):
                    keys.append(k)
                    sigs.append(sig)
                    size += len(k)
                if size >= FLUSH_KEYS:
                    yield flush(keys, sigs)
                    keys, sigs, size = [], [], 0
        if keys:
            yield flush(keys, sigs)

    return releasing(run)


def _by_bucket(key: np.ndarray, owner: np.ndarray, number: np.ndarray | None, buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    key, owner, bucket = key[order], owner[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
    sets = [b""] * len(cuts) if number is None else [x.tobytes() for x in np.split(number[order], cuts[1:])]
    return list(zip(bucket[cuts].tolist(), [k.tobytes() for k in np.split(key, cuts[1:])], [x.tobytes() for x in np.split(owner, cuts[1:])], sets, strict=False))


def _runs(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, how many rows it has, and a number that stands for the rows' columns."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    print_ = np.zeros(len(key), np.uint64)
    for c in columns:
        print_ = mix(print_ + c.view(np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(print_)])
    return first, size, mix(total[first + size] - total[first] + size.astype(np.uint64))


def _members(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows of runs, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum()) if len(first) else np.zeros(0, np.int64)


def _match(buckets: int):
    """Of one bucket: kind 0, pairs (a, b) of the least class of a block and another; kind 1, members b of block a with over two
    classes; kind 2, sets b of classes of block a. Of a bucket above `buckets`: kind 3, members b of set a, and pairs."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()])
        key_, sig = read("keys", np.uint64), read("sigs", np.int64)
        if key[0].as_py() >= buckets:
            first = np.flatnonzero(np.concatenate([[True], key_[1:] != key_[:-1]]))
            pivot = np.repeat(sig[first], np.diff(np.append(first, len(key_))))  # the members of a set are sorted
            return _kinds((0, pivot[sig != pivot], sig[sig != pivot]), (3, key_.view(np.int64), sig))
        number = np.concatenate([np.frombuffer(x, np.uint64) if x else np.zeros(len(k) // 8, np.uint64) for x, k in zip(group.column("sets").to_pylist(), group.column("keys").to_pylist(), strict=True)])
        order = np.lexsort((number, sig, key_))
        key_, sig, number = key_[order], sig[order], number[order]
        new = np.concatenate([[True], (key_[1:] != key_[:-1]) | (sig[1:] != sig[:-1]) | (number[1:] != number[:-1])])
        key_, sig, number = key_[new], sig[new], number[new]
        first, size, print_ = _runs(key_, sig, number)
        with_set = np.maximum.reduceat(number, first) > 0
        # Blocks with the same classes say the same thing once.
        open_ = np.flatnonzero((size > 1) | with_set)
        _, once = np.unique(print_[open_], return_index=True)
        first, size, with_set = first[open_[once]], size[open_[once]], with_set[open_[once]]
        member = _members(first, size)
        pivot = np.repeat(sig[first], size) if len(first) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([pivot, sig[member]], 1)[sig[member] != pivot], axis=0)
        big = member[np.repeat((size > 2) | with_set, size)] if len(first) else member
        named = big[number[big] > 0]
        return _kinds((0, pairs[:, 0], pairs[:, 1]), (1, key_[big].view(np.int64), sig[big]), (2, key_[named].view(np.int64), number[named].view(np.int64)))

    return run


def _kinds(*parts: tuple[int, np.ndarray, np.ndarray]) -> pa.Table:
    kind = np.repeat([k for k, _, _ in parts], [len(a) for _, a, _ in parts])
    return pa.table({"kind": pa.array(kind, pa.int8()), "a": pa.array(np.concatenate([a for _, a, _ in parts]), pa.int64()), "b": pa.array(np.concatenate([b for _, _, b in parts]), pa.int64())})


def parity_sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The dense sketch as 64-bit words: bit i is the parity of the shingles whose hash ends in i."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch (or rows of them) of fewer bits: parities of halves add up."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _sketches(percent: int):
    schema = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set_signature(s), len(s), parity_sketch(s, SKETCH_BITS << level(len(s), percent)).tobytes()) for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
            if rows:
                yield _batches(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("sig", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        sigs, blobs, size = [], [], 0
        for s in shingle_sets(batch.column(0).to_pylist()):
            if len(s):
                sigs.append(set_signature(s))
                blobs.append(s.tobytes())
                size += s.nbytes
            if size > 8 << 20:
                yield _batches({"sig": sigs, "shingles": blobs}, schema)
                sigs, blobs, size = [], [], 0
        yield _batches({"sig": sigs, "shingles": blobs}, schema)


def _may_link(n: np.ndarray | int, m: np.ndarray | int, distance: np.ndarray | int, percent: int):
    """Sizes that can reach the threshold, and a Hamming distance that does not rule it out."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (distance * (100 + percent) <= (100 - percent) * (n + m))


def _near(percent: int):
    """Of rows (a, b, n, m, x, y) the pairs whose sketches x, y are near enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            distance = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                distance[i] = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
            keep = pa.array(_may_link(n, m, distance, percent))
            yield _batches({"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}, schema)

    return run


def _tile(percent: int, nearest: bool):
    """Of one tile of a block, the pairs in different components whose sketches are near enough; in large blocks of each class only the nearest, if so asked."""

    def run(group: pa.Table) -> pa.Table:
        sig, root, n = (group.column(c).to_numpy() for c in ("b", "root", "n"))
        left, right = group.column("left").to_numpy(), group.column("right").to_numpy()
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("sketch")]
        words = min(map(len, raw))
        sketch = np.stack([folded(x, words) for x in raw])
        out: list[np.ndarray] = []
        if len(sig) <= SMALL:
            distance = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(2, dtype=np.int64)
            x, y = np.nonzero(_may_link(n[:, None], n[None], distance, percent) & (root[:, None] != root[None]) & (sig[:, None] < sig[None]))
            out.append(np.stack([sig[x], sig[y]], 1))
        else:
            # Members of the largest component need no test against each other: hold the others against all.
            values, counts = np.unique(root[right], return_counts=True)
            rest = root != values[np.argmax(counts)] if len(values) else np.ones(len(root), bool)
            for at in np.flatnonzero(left & rest):
                other = np.flatnonzero(right & (root != root[at]))
                out.append(_survivors(sig, n, sketch, at, other, percent, nearest))
            main, others = np.flatnonzero(left & ~right & ~rest), np.flatnonzero(right & ~left & rest)
            for at in others if len(main) else []:
                out.append(_survivors(sig, n, sketch, at, main, percent, nearest))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _survivors(sig: np.ndarray, n: np.ndarray, sketch: np.ndarray, at: int, other: np.ndarray, percent: int, nearest: bool) -> np.ndarray:
    distance = np.bitwise_count(sketch[other] ^ sketch[at]).sum(1, dtype=np.int64)
    may = np.flatnonzero(_may_link(n[other], n[at], distance, percent))
    if nearest:
        may = may[np.argsort(distance[may], kind="stable")[:1]]
    near = other[may]
    return np.stack([np.minimum(sig[near], sig[at]), np.maximum(sig[near], sig[at])], 1)


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(y) < len(x):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield _batches({"a": batch.column(0).filter(pa.array(keep)), "b": batch.column(1).filter(pa.array(keep))}, schema)

    return run


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The text of one row for each class of `pairs`. Ids are broadcast where they are few; else the texts are shuffled to them."""
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    ids = durable(wanted.join(classes, "sig").select(F.col("doc_id").alias("_id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select(F.col("text").cast("binary"))


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold."""
    sets = durable(_texts(docs, classes, pairs).mapInArrow(releasing(_sets), "sig long, shingles binary"), "sets")
    sides = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return durable(sides.select("a", "b", "x", "y").mapInArrow(releasing(_verify(percent)), _PAIR).distinct(), "verified")


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that sketches do not rule out."""
    sides = pairs.join(sketches.toDF("a", "n", "x"), "a").join(sketches.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    return durable(sides.mapInArrow(releasing(_near(percent)), _PAIR).distinct(), "near")


def _across(groups: DataFrame, sketches: DataFrame, labels: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs within blocks that are in different components and near by their sketches.

    groups: (a, b), class b has block a, each once. nearest: small blocks in full, of large
    ones the nearest of each class; else large ones in full. A block of many
    classes is cut into tiles, pairs of its parts, so no task holds more than
    two parts.
    """
    members = groups.withColumnRenamed("a", "block").join(labels.toDF("b", "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    open_ = members.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low <> high")
    open_ = open_ if nearest else open_.filter(F.col("size") > SMALL)
    members = members.join(open_.select("block", F.ceil(F.col("size") / TILE).cast("int").alias("parts")), "block")
    members = members.join(sketches.withColumnRenamed("sig", "b"), "b").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    tiles = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "b", "root", "n", "sketch")
    tiles = tiles.select("block", "i", "j", "b", "root", "n", "sketch", (F.col("part") == F.col("i")).alias("left"), (F.col("part") == F.col("j")).alias("right"))
    return tiles.groupBy("block", "i", "j").applyInArrow(_tile(percent, nearest), _PAIR).distinct()


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n, root and component_id of each row; root names the component, null without shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    hashed = docs.select("doc_id", F.xxhash64("text"), F.col("text").cast("binary"))
    first = durable(hashed.mapInArrow(releasing(_signatures), "kind byte, doc_id long, text_hash long, n long, sig long"), "signatures")
    rows = first.filter("kind = 0").select("doc_id", "text_hash", "n", "sig")
    top = first.filter("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sig").limit(FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in top.select("sig").collect()], np.int64).view(np.uint64)))
    classes = durable(rows.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "classes")
    slope = (100 - percent) * (1 + 100 / percent) / (100 + percent)
    keys = classes.agg(F.sum(F.col("n") * 1.5 * slope + 2)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(keys / BUCKET_KEYS) + 1)
    blocks = docs.select(F.col("text").cast("binary")).mapInArrow(_emit_blocks(frequent, buckets, percent), "bucket int, keys binary, sigs binary, sets binary")
    found = durable(blocks.groupBy("bucket").applyInArrow(_match(buckets), "kind byte, a long, b long"), "blocks")
    of = lambda kind: found.filter(F.col("kind") == kind).select("a", "b").distinct()
    in_sets = of(2).toDF("a", "_set").join(of(3).toDF("_set", "b"), "_set").select("a", "b")
    members = durable(of(1).union(in_sets).distinct(), "members")
    pairs = durable(found.filter("kind = 0").select("a", "b").distinct(), "pairs")
    sketches = durable(_texts(docs, classes, pairs).mapInArrow(releasing(_sketches(percent)), "sig long, n long, sketch binary"), "sketches")
    links = _links(docs, classes, _sketched(pairs, sketches, percent), percent)
    labels = components(links)
    for nearest in (True, False):
        more = durable(_across(members, sketches, labels, percent, nearest).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty() and not nearest:
            break
        links, pairs = links.union(_links(docs, classes, more, percent)), pairs.union(more)
        labels = components(links)
    roots = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("root", "sig").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(roots.select("sig", "root").join(least, "root"), "sig", "left")
    return out.select("doc_id", "text_hash", "n", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text).

    component_id is the least doc_id that links reach, itself included. Null
    and empty texts have no shingles and are linked with nothing. Repeated rows
    each come back. A null doc_id joins the components of its text, without
    lending them its id. Further columns of `docs` are ignored; an empty table
    gives an empty one.
    """
    return _components(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` without near copies, with their own columns: of each component the least doc_id (ties: the least hash of the text).

    Rows without shingles stay, but repeated rows of one doc_id and text are one.
    """
    rows = durable(_components(docs, percent), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    kept = rows.filter("root IS NOT NULL").groupBy("root").agg(first.alias("r")).select("r.doc_id", "r.text_hash")
    kept = kept.union(rows.filter("root IS NULL").select("doc_id", "text_hash").distinct()).toDF("_id", "_hash")
    out = docs.withColumn("_text_hash", F.xxhash64("text"))
    out = out.join(kept.hint("shuffle_hash"), out["doc_id"].eqNullSafe(kept["_id"]) & (out["_text_hash"] == kept["_hash"]), "left_semi")
    if not rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_text_hash"])
    return out.drop("_text_hash")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; null texts and texts without words have no shingles and are their own component."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN coalesce(len(w), 0) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words
), n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) m USING (doc_id)
"""
QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE = {"op4_jaccard_join": SQL}
