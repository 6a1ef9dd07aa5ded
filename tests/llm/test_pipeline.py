import corpus_pipeline
import __spark_entry__
from tidemark.llm import catalogue


def test_registered():
    assert {int(k[2:].split("_")[0]) for k in catalogue.QUERIES} == set(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_stages_follow_from_each_other(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, sf), name)
        assert docs.columns == columns
        n = docs.count()
        assert 0 < n and (n <= before or name == "source_mixing")
        before = n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == before


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, path):
    """Documents with nulls, empty texts, repeated rows, near copies and a benchmark passage."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "to", "in"]) if r.random() < 0.3 else word() for _ in range(n)) + "."
    good = [prose(120) for _ in range(12)]
    item = prose(14)
    texts = good + [good[0] + " again", good[1], None, "", "# " * 90, prose(60) + "\n" + item + "\n" + prose(60)]
    rows = [(k, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[2], (None, good[3] + " more words here", "en", "a", 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item


def test_each_stage_on_odd_rows(spark, tmp_path):
    rows, item = fixture(spark, tmp_path)
    sf, docs, kept = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, sf), name)
        kept[name] = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = {x.text for x in kept["quality_rules"]}
    assert None not in first and "" not in first and "# " * 90 not in first and {t for _, t, *_ in rows[:12]} <= first
    joined = sorted((x.doc_id for x in kept["jaccard_join"]), key=repr)
    assert joined == sorted([*range(12), 17], key=repr)  # of copies the least doc_id, of repeated rows one
    cut = {x.doc_id: x.text for x in kept["benchmark_decontamination"]}
    assert sorted(cut) == sorted(joined) and item not in cut[17] and len(cut[17].split()) == 120 and all(cut[k] == rows[k][1] for k in range(12))
    assert {x.doc_id for x in kept["source_mixing"]} <= set(cut) and all(x.text == cut[x.doc_id] for x in kept["source_mixing"])
    words = sum(len(t.split()) for t in cut.values())
    assert abs(sum(len(x.text.split()) for x in kept["source_mixing"]) - 1.5 * words) <= 3 * 130
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).orderBy("start").collect()
    assert [x.doc_id for x in out] == sorted(x.doc_id for x in kept["source_mixing"])
    assert [x.start for x in out] == [sum(y.n_tokens for y in out[:k]) for k in range(len(out))]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    fixture(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0
