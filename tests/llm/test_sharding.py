import random
import zlib

from tidemark.llm import sharding as s


def test_assignment(spark):
    r = random.Random(1)
    rows = [(k, "é" * r.randint(0, 200)) for k in range(3000)] + [(1, None), (None, "x"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, slot int, shard int")
    placed = s.with_slots(docs)
    versions = s.slot_map(placed)
    got = s.assign(placed, versions).collect()
    assert len(got) == len(rows)
    size = {}
    for k in range(8):
        xs = [x for x in got if x.shard == k]
        assert sorted(x.slot for x in xs) == list(range(len(xs)))
        size[k] = sum(x["size"] for x in xs)
    assert max(size.values()) - min(size.values()) <= 50
    assert sorted((x["size"], x.text_crc32) for x in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    # A later version moves few slots and keeps the earlier ones.
    third = s.slot_map(placed, before=versions)
    maps = {v: {x.virtual_slot: x.shard for x in third.collect() if x.version == v} for v in (1, 2, 3)}
    assert maps[2] == maps[3] and sum(maps[1][k] != maps[2][k] for k in maps[1]) < 200


def test_edit_with_one_heavy_slot():
    sizes = [1] * 64
    sizes[3] = 1000
    out = s.edited_map(s.first_map(64, 4), sizes, 4)
    load = [sum(sizes[k] for k in range(64) if out[k] == x) for x in range(4)]
    assert sorted(load) == [21, 21, 21, 1000]


def test_empty_table(spark):
    placed = s.with_slots(spark.createDataFrame([], "doc_id long, text string"))
    assert s.assign(placed, s.slot_map(placed)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8, "x"), (1, "a", 7, 8, "x")], "doc_id long, text string, virtual_slot int, size int, text_crc32 string")
    placed = s.with_slots(docs)
    assert placed.columns == ["doc_id", "size", "text_crc32", "virtual_slot"]
    assert sorted(x.slot for x in s.assign(placed, s.slot_map(placed)).collect()) == [0, 1]
