"""Epochs of training: history, early end, stored models, held-out figures."""

import pytest
from pyspark.sql import functions as F

from listingloom import queries
from listingloom.operators import metrics
from listingloom.plans import training
from listingloom.plans.compare import compare, spot_check
from listingloom.plans.scoring import LogisticScorer, ProbabilityScorer, RuleScorer


@pytest.fixture(scope="module")
def rows(spark):
    """Two features of which the first tells the class; one row in six is positive."""
    return spark.range(600).select("id", F.array((F.col("id") % 6 == 0).cast("double") * 3 + (F.col("id") % 11) / 11, (F.col("id") % 7).cast("double"), F.lit(1.0)).alias("features"), (F.col("id") % 6 == 0).cast("int").alias("label"))


def test_rates_rise_and_fall():
    assert training.rates(4, 1.0, 0.0) == [1.0, 0.75, 0.5, 0.25]
    assert training.rates(10, 1.0, 0.2)[:4] == [1 / 3, 2 / 3, 1.0, 7 / 8]


def test_history_falls_and_the_best_epoch_is_kept(spark, rows, tmp_path):
    model, history = training.fit(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), ["id"], epochs=12)
    told = history.orderBy("epoch").collect()
    assert told[-1]["val_loss"] < told[0]["val_loss"] < 0.7 and abs(told[0]["train_loss"] - 0.693147) < 1e-5
    best = metrics.best_epoch(history).first()
    assert best["best_metric"] == max(r["f1"] for r in told) > 0.99
    model.save(spark, str(tmp_path / "m"))
    again = training.LinearModel.load(spark, str(tmp_path / "m"))
    assert again == model
    right = rows.select((F.get(again.probabilities("features"), F.lit(1)) >= 0.5).cast("int").alias("p"), "label").where("p = label").count()
    assert right > 590
    points = training.curves(history).groupBy("figure", "series").count().collect()
    assert {(r["figure"], r["series"], r["count"]) for r in points} == {("loss", "train", len(told)), ("loss", "val", len(told)), ("accuracy", "val", len(told)), ("f1", "val", len(told))}


def test_epochs_end_early_as_the_operator_tells(spark, rows):
    _, history = training.fit(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), ["id"], epochs=30, least=0.05, patience=2)
    stop = metrics.early_stop(history, patience=2, min_delta=0.05).first()["stop_epoch"]
    assert stop is not None and history.agg(F.max("epoch")).first()[0] == stop < 29


def test_rows_in_any_partitions_train_the_same(spark, rows):
    a = training.fit(rows.where("id < 400"), rows.where("id >= 400"), ["id"], epochs=2)[0]
    b = training.fit(rows.repartition(9).where("id < 400"), rows.where("id >= 400"), ["id"], epochs=2)[0]
    assert all(abs(x - y) < 1e-9 for x, y in zip((a.constant, *a.weights), (b.constant, *b.weights), strict=True))


def test_odd_tables(spark, rows):
    with pytest.raises(ValueError):
        training.fit(rows.limit(0), rows, ["id"])
    one = rows.where("label = 0")
    _, history = training.fit(one, one.limit(0), ["id"], epochs=2)
    assert history.count() == 2 and [r["f1"] for r in history.collect()] == [0.0, 0.0]


def test_documents_held_out(spark):
    d = "/root/testdata/sf0.1"
    split = queries._measured(spark, d)
    model, history = training.fit(split.where("split = 'train'"), split.where("split = 'val'"), ["doc_id"], epochs=40, patience=6)
    test = split.where("split = 'test'").select("label", model.probabilities("features").alias("probs"))
    found = metrics.compute_metrics(test.select(F.col("label").alias("y"), (F.get("probs", F.lit(1)) >= 0.5).cast("int").alias("p")), classes=2).first()
    share = test.agg(F.avg("label")).first()[0]
    assert test.count() > 400 and found["accuracy"] > max(share, 1 - share) - 0.02 and found["f1"] > 0.6, (found, share, history.collect())


def test_a_trained_scorer_is_read_back(spark, tmp_path):
    product = "struct<id:string,title:string,brand:string,description:string>"
    pairs = [(("1", f"Nova {i} phone", "Aurel", "128GB black"), ("2", f"Nova {i} phone", "Aurel", "128GB black"), 1) for i in range(8)]
    pairs += [(("1", f"Nova {i} phone", "Aurel", "128GB"), ("2", f"Runner {i} shoe", "Strada", "red"), 0) for i in range(8)]
    df = spark.createDataFrame(pairs, f"original {product}, candidate {product}, label int")
    scorer = LogisticScorer().fit(df)
    scorer.save(str(tmp_path / "s"))
    again = LogisticScorer.load(str(tmp_path / "s"))
    assert [r["similarity_score"] for r in again.transform(df).collect()] == [r["similarity_score"] for r in scorer.transform(df).collect()]
    assert again.parameter_counts() == {"total": len(LogisticScorer.FEATURES) + 1, "trainable": len(LogisticScorer.FEATURES) + 1}


def test_spot_check_takes_a_chain(spark):
    rows = spark.createDataFrame([(str(i), f"item {i}", "b", "") for i in range(30)], "id string, title string, brand string, description string")
    made = spot_check(rows, RuleScorer(), 10).select("product1_id", "product2_id").collect()
    nexts = dict(map(tuple, made))
    assert len(made) == 9 and len(nexts) == 9 and len(set(nexts) | set(nexts.values())) == 10
    assert spot_check(rows.limit(1), RuleScorer()).count() == spot_check(rows.limit(0), RuleScorer()).count() == 0
    probs = compare(spark.createDataFrame([("a", "b", [0.45, 0.55])], "product1_title string, product2_title string, probs array<double>"), ProbabilityScorer(0.6)).first()
    assert probs["prediction"] == "Different Product"
