"""The classifiers: what they may see, held-out accuracy, awkward rows; and the pipeline end to end."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import learning, quality, toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.85), (quality, "quality", 0.95)])
def test_held_out_accuracy_and_awkward_rows(spark, data, module, label, least):
    at = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = module.fit(docs, labels)
    got = module.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert auc(out.score.to_numpy(), out[label].to_numpy()) > least
    extra = "doc_id long, text string, lang string, score string, predicted int, y int"
    rows = [(1, None, None, "s", 1, 1), (2, "", "en", "s", 1, 1), (None, "a b", "xx", "s", 1, 1), (3, "é" * 200_000, "en", "s", 1, 1), (4, "word " * 50_000, "de", "s", 1, 1), (4, "word " * 50_000, "de", "s", 1, 1)]
    odd = module.score(spark.createDataFrame(rows, extra), model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] == 4}) == 1
    assert module.score(spark.createDataFrame([], extra), model).count() == 0
    # scores don't depend on lang, and labels of held-out rows change nothing
    other = module.score(docs.withColumn("lang", F.lit("zz")), model).select("doc_id", "score")
    same = module.score(docs, model).select("doc_id", F.col("score").alias("s")).join(other, "doc_id")
    assert same.where("abs(s - score) > 1e-9").count() == 0
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    again = module.fit(docs, flipped)
    key = "u"
    assert np.array_equal(model[key], again[key])
    assert module.fit(docs, labels.where(f"{label} = 1")) is None


def test_thresholds_come_from_all_rows(spark):
    """The best F1 over every row, as a plain pass over the sorted scores finds it; a class that is missing gives the default."""
    def plain(score, y):
        order = np.argsort(-score, kind="stable")
        s, hit = score[order], np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        f1[:-1][s[:-1] == s[1:]] = -1
        k = int(f1.argmax())
        return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])

    r = np.random.default_rng(5)
    rows, want = [("one", 0.25, 1), ("one", 1.0, 1), ("none", 0.5, 0)], {"one": 0.7, "none": 0.7}
    for lang, n, places in (("a", 9000, 9), ("b", 500, 1), ("c", 2, 3)):
        y = (np.arange(n) % 5 == 0).astype(int)
        score = np.round(np.clip(0.3 * y + r.uniform(0, 0.7, n), 0, 1), places)
        want[lang] = plain(score, y)
        rows += list(zip([lang] * n, score.tolist(), y.tolist()))
    for parts in (1, 3, 4096):
        got = {x["lang"]: x["threshold"] for x in learning.best_thresholds(spark.createDataFrame(rows, "lang string, score double, y int"), 0.7, parts).collect()}
        assert got == pytest.approx(want, abs=1e-15)


def test_attention_gradient_points_down():
    r = np.random.default_rng(1)
    bags = [r.normal(size=(int(r.integers(1, 9)), quality.WIDTH)) for _ in range(200)]
    y = np.array([int(b[:, 0].max() > 1.2) for b in bags])
    p = quality.train(bags, y, epochs=120)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    assert ((quality.forward(p, np.concatenate(bags), begin)[-1] > 0) == y).mean() > 0.9


def test_pipeline(spark, data):
    import __spark_entry__ as entry
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.stash(stage(spark, seen, data), "test")
        assert seen.columns == docs.columns, name
        if name == "quality":
            labels = spark.read.parquet(f"{data}/labels.parquet")
            assert seen.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * labels.where("quality = 1").count()
        if name == "near-duplicates":
            ids = {r[0] for r in seen.select("doc_id").collect()}
            assert len(ids) == seen.count()
    packed = entry.queries()["pipeline"](spark, data)
    words = seen.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert packed.agg(F.sum("n_tokens")).first()[0] == words


def test_thresholds_move_no_text(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = toxicity.scored_labels(docs, labels, None)
        plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
        assert rows.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    below = [x for x in plan[at + 1 :] if len(x) - len(x.lstrip(" :+-")) > depth]
    assert any("Exchange" in x for x in plan[:at]) and not any("Exchange" in x for x in below[:4])
