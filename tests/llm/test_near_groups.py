"""Groups of edited copies in the pipeline's near-duplicate stage, and the rows that need no partner."""

import random

from pyspark.sql import functions as F

from skeinwatch.llm import simhash


def test_edits_of_one_text_leave_few_pairs_for_the_last_step(spark, monkeypatch):
    """Each copy is like the text it was made of (0.8 and more), no two copies are: all pairs of copies were tried before."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(200)]
    texts = [base]
    for _ in range(80):
        copy = list(base)
        for i in rng.sample(range(10, 190, 6), 4):
            copy[i] = word()
        texts.append(copy)
    texts += [[word() for _ in range(200)] for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(n, " ".join(texts[i])) for n, i in enumerate(order)], "doc_id long, text string")
    left, inner = [], simhash._left_pairs
    monkeypatch.setattr(simhash, "_left_pairs", lambda *a: left.append(inner(*a)) or left[0])
    kept = {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()}
    group = [n for n, i in enumerate(order) if i <= 80]
    assert kept == {min(group)} | {n for n, i in enumerate(order) if i > 80}
    assert left[0].count() < 80


def test_bitmap_loses_no_key(spark):
    keys = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k"), F.lit("user").alias("_bits"), F.lit("user").alias("_number"))
    wanted = keys.filter(F.xxhash64("k") % 10 == 0).select("k")
    flagged = simhash._perhaps(keys, "k", wanted, "asked")
    assert flagged.columns == ["k", "_bits", "_number", "asked"] and flagged.count() == 3000
    asked = {r["k"] for r in flagged.filter("asked").collect()}
    there = {r["k"] for r in wanted.collect()}
    assert there <= asked and len(asked) < len(there) + 30
    assert simhash._perhaps(keys, "k", wanted.limit(0), "asked").filter("asked").count() == 0


def test_cells_of_fingerprints_are_never_broadcast(spark):
    """Few bytes of fingerprints become fifty rows each: by Spark's guess they would fit a broadcast."""
    prints = spark.range(200).select(F.xxhash64("id").alias("fp"))
    distinct = prints.unionByName(prints.select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp")))
    links = simhash.fingerprint_links(distinct)
    found = {(r["a"], r["b"]) for r in links.collect()}
    fps = [r["fp"] for r in prints.collect()]
    assert found >= {(min(f, f ^ 5), max(f, f ^ 5)) for f in fps} and len(found) == 200
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
