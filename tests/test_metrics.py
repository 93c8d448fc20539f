"""Metrics against hand-made values."""

import random

import pytest
from pyspark.sql import functions as F

from listingloom.operators import audit, benchmarks, generators, metrics


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, score double")
    assert metrics.roc_auc(df).first()["auc"] == 0.875
    assert metrics.roc_auc(df.where("y = 1")).first()["auc"] is None


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert tuple(metrics.compute_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)


def test_early_stop_and_best(spark):
    df = spark.createDataFrame([(i, v, f) for i, (v, f) in enumerate([(1.0, 0.1), (0.9, 0.5), (0.95, 0.5), (0.9, 0.2), (0.92, 0.3), (0.1, 0.4)])], "epoch int, val_loss double, f1 double")
    assert tuple(metrics.early_stop(df).first()) == (4, 0.9)
    assert metrics.best_epoch(df).first()["best_epoch"] == 1


def test_class_weights_for_absent_class(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "label int")
    assert {r["class"]: r["weight"] for r in metrics.class_weights(df, [0, 1, 2]).collect()} == {0: 0.5, 1: 1.0, 2: 1.0}


def test_cross_entropy_and_running_average(spark):
    df = spark.createDataFrame([([0.5, 0.5], 0), ([1.0, 0.0], 0)], "probs array<double>, label int")
    assert abs(metrics.cross_entropy(df).first()["loss"] - 0.34657359) < 1e-6
    assert metrics.running_average(spark.createDataFrame([], "v double, n int"), "v", "n").first()["average"] == 0.0


def test_audit(spark):
    df = spark.createDataFrame([("Acme phone", None), ("ACME", "x.y")], "product1_title string, product1_brand string")
    rows = [tuple(r) for r in audit.ordered(audit.coverage(df, ["acme", "x.y", "None"], thin=2)).collect()]
    assert rows == [("None", 0, "MISSING"), ("x.y", 1, "THIN"), ("acme", 2, "OK")]


@pytest.mark.parametrize("index_bytes", [40, 32 << 20])
def test_audit_against_all_cells(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(audit, "INDEX_BYTES", index_bytes)
    r = random.Random(4)
    word = lambda: "".join(r.choice("aAbé\U0001f600 ") for _ in range(r.randint(0, 7)))
    cells = [(word() if i % 9 else None, word() * r.randint(1, 40)) for i in range(300)] + [("the same hot cell", "")] * 50
    brands = sorted({word() for _ in range(60)} | {"a", "é", "ab", "\U0001f600", "same", "SAME", "hot cell", "none of these"}) + ["a", None, ""]
    df = spark.createDataFrame(cells, "title string, description string")
    got = {x.brand: x.mentions for x in audit.coverage(df, brands).collect()}
    every = [c.lower() for row in cells for c in row if c]
    assert got == {b: sum(b.lower() in c for c in every) for b in brands if b}
    assert audit.coverage(df.limit(0), ["a"]).first()["status"] == "MISSING" and audit.coverage(df, [""]).count() == 0


def test_audit_plan_has_one_scan_and_shuffles_no_cell(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("acme phone", "d")] * 9, "title string, description string").write.parquet(path)
    names = spark.range(500).select(F.concat(F.lit("brand number "), "id").alias("brand")).withColumn("low", F.col("brand"))
    index = spark.createDataFrame(audit.brand_index(names.select("low"), audit.cells_of(spark.read.parquet(path))).collect())
    met = audit.cells_of(spark.read.parquet(path)).select("cell", F.explode(audit.grams(F.col("cell"))).alias("gram")).join(F.broadcast(index), "gram")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_benchmark_pairs(spark):
    a = benchmarks.product_fields(spark.createDataFrame([(i, f"tv  {i}", "d", "1") for i in range(30)], "id int, name string, description string, price string"), "abt")
    b = benchmarks.product_fields(spark.createDataFrame([(i, f"set {i}", "d", "m", "1") for i in range(30)], "id int, name string, description string, manufacturer string, price string"), "buy")
    m = spark.createDataFrame([(i, i) for i in range(10)] + [(99, 1)], "idAbt int, idBuy int")
    rows = benchmarks.generate_pairs(a, b, m, "idAbt", "idBuy").collect()
    assert sum(r["label"] for r in rows) == 10 and sum(1 - r["label"] for r in rows) == 15
    assert all(r["product1_id"] != r["product2_id"] or int(r["product1_id"]) >= 10 for r in rows if r["label"] == 0)


def test_generators(spark):
    base = generators.families(spark)
    rows = generators.generate(base, 40, "with_specs").collect()
    assert {r["label"] for r in rows} == {0, 1} and all(r["product1_title"].lower() != r["product2_title"].lower() for r in rows)
    near = generators.near_misses(base).groupBy("kind").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    assert {r["kind"] for r in near} == {"model", "storage", "color", "extra"}
    products = spark.range(12).select(F.col("id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("b").alias("brand"), F.lit("d").alias("description"))
    made = generators.missing_brand_pairs(products, products.where("id < 3").select(F.col("id").alias("base_id"), F.upper("title").alias("title")))
    assert made.where("label = 1").count() == 3 and made.where("label = 0").count() == 66


def test_first_gold_pairs_meet_by_titles(spark):
    from listingloom.operators import dedupe

    side = lambda n, word: spark.createDataFrame([(str(i), f"{word if i % 3 else 'T'}{i % 5}" if i % 7 else "", "b", "long description") for i in range(n)], "id string, title string, brand string, description string")
    a, b = side(60, "t"), side(30, "S")
    m = spark.createDataFrame([((i * 7) % 61, (i * 5) % 31) for i in range(400)] * 2, "x int, y int")
    key = ["product1_id", "product2_id"]
    want = dedupe.unordered_first(benchmarks._titled(benchmarks.gold_pairs(a, b, m.distinct(), "x", "y")), "product1_title", "product2_title", key, trim=False)
    for most in (0, 100):
        benchmarks.MOST_BROADCAST, before = most, benchmarks.MOST_BROADCAST
        try:
            assert sorted(map(tuple, benchmarks.first_gold_pairs(a, b, m, "x", "y").collect())) == sorted(map(tuple, want.collect()))
            made = sorted(map(tuple, benchmarks.generate_pairs(a, b, m, "x", "y").collect()))
            assert len(made) == len(set(made)) > 0 and made == sorted(map(tuple, benchmarks.generate_pairs(a, b, m.distinct(), "x", "y").collect()))
        finally:
            benchmarks.MOST_BROADCAST = before
