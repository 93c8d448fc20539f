"""Blocks of any size, overlap bands, cuts, places, draws and lines of several files."""

import random

import pytest
from pyspark.sql import functions as F

from listingloom.operators import catalog, overlap, pairs, sampling, synth
from listingloom.sources import readers, sinks


@pytest.mark.parametrize("most", [1, 7, 50, 2000])
def test_pairs_of_hot_blocks(spark, most):
    rows = [(i, "hot" if i % 5 else "cold") for i in range(150)] + [(999, None), (998, None), (None, "hot"), (3, "hot")]
    df = spark.createDataFrame(rows, "id long, k string")
    got = [tuple(r) for r in pairs.blocked_pairs(df, ["k"], most=most).select("a.id", "b.id").collect()]
    ids = [r for r in rows if r[0] is not None]
    want = [(a, b) for a, k in ids for b, q in ids if k == q and k and a < b]
    assert sorted(got) == sorted(want)


def test_hot_blocks_are_dealt_evenly(spark):
    df = spark.createDataFrame([(i, "hot" if i % 5 < 2 else f"k{i}") for i in range(4000)], "id long, k string")
    met = pairs.blocked_pairs(df, ["k"], most=100).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))
    assert met.count() == 1600 * 1599 // 2
    chunk = F.pmod(F.xxhash64(F.col("i")), F.lit(16)), F.pmod(F.xxhash64(F.col("j")), F.lit(16))
    places = met.groupBy(F.least(*chunk).alias("c"), F.greatest(*chunk).alias("d")).count().agg(F.max("count"), F.count("*")).first()
    assert places[1] == 16 * 17 // 2 and places[0] < 150 * 150


@pytest.mark.parametrize("most", [3, 2000])
def test_two_sides_met_in_blocks(spark, most):
    a = spark.createDataFrame([(i, "k" if i % 3 else "q") for i in range(40)] + [(1, "k"), (77, None)], "id long, k string")
    b = spark.createDataFrame([(i, "k" if i % 7 else None) for i in range(30)], "id long, k string")
    got = sorted((r.x.id, r.y.id) for r in pairs.met_in_blocks(a, b, ["k"], most).collect())
    assert got == sorted((x.id, y.id) for x in a.collect() for y in b.collect() if x.k == y.k and x.k)


@pytest.mark.parametrize("low,high", [(0.05, 0.3), (0.25, 0.55), (0.5, 1.01), (0.9, 1.01)])
def test_bands_against_all_pairs(spark, low, high):
    r = random.Random(int(low * 100))
    rows = []
    for i in range(160):
        words = r.sample(range(30), r.randint(0, 9)) if i % 4 else list(range(5))
        brand = r.choice(["Main", "Main ", "main", "Odd", "", None]) if i % 3 else "Main"
        rows.append((i, brand, r.choice(["c", "c", "d", None]), words))
    df = spark.createDataFrame(rows, "id long, brand string, cat string, _tokens array<long>")
    want = set()
    name = lambda b: (b or "").strip().lower()
    for i, p, c, t in rows:
        for j, q, e, u in rows:
            if i < j and c == e and c and name(p) != name(q) and t and u and low <= len(set(t) & set(u)) / len(set(t) | set(u)) < high:
                want.add((i, j))
    got = [(r["_i"], r["_j"]) for r in overlap.band_join(df, "cat", low, high).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        overlap.band_join(df, "cat", 0.0, 1.0)


def test_band_plan_meets_by_tokens(spark):
    df = spark.createDataFrame([(1, "a", "c", [1, 2])], "id long, brand string, cat string, _tokens array<long>")
    plan = overlap.band_join(df, "cat", 0.25, 0.55)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Inner, (((" in plan  # category, token and both chunks


@pytest.mark.parametrize("n", [0, 1, 100, 2999, 3000, 5000])
def test_cut_is_the_top_n(spark, n):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("x"))
    top = {r.id for r in df.orderBy(F.md5(F.concat(F.lit("5|"), F.col("id").cast("string"))), "id").limit(n).collect()}
    got = [r.id for r in sampling.cut(df, n, 5, "id").collect()]
    assert len(got) == len(top) and set(got) == top
    plan = sampling.cut(df, n, 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_places_have_no_gaps(spark):
    df = spark.createDataFrame([(i, "hot" if i % 4 else None if i % 8 else "few") for i in range(500)], "id long, k string")
    assert sorted(r.position for r in sampling.numbered(df, 1, "id").collect()) == list(range(500))
    by = {}
    for r in sampling.numbered(df, 1, "id", by="k").collect():
        by.setdefault(r.k, []).append(r.position)
    assert {k: sorted(v) == list(range(len(v))) for k, v in by.items()} == {"hot": True, "few": True, None: True}


def test_draws_take_groups_evenly(spark):
    df = spark.createDataFrame([(i, "large" if i < 900 else "small" if i < 930 else "pair" if i < 932 else "one" if i < 933 else None) for i in range(950)], "id long, k string")
    rows = synth.uniform_pairs(df, "k", 3000, 9).collect()
    assert sorted(r.draw for r in rows) == list(range(3000)) and all(r.a.id != r.b.id and r.a.k == r.b.k for r in rows)
    counts = {}
    for r in rows:
        counts[r.a.k] = counts.get(r.a.k, 0) + 1
    assert set(counts) == {"large", "small", "pair"} and all(abs(n - 1000) < 5 * 26 for n in counts.values())  # five standard deviations
    assert len({(r.a.id, r.b.id) for r in rows if r.a.k == "large"}) > 0.99 * counts["large"]
    assert synth.uniform_pairs(df.limit(0), "k", 10).count() == 0


def test_lines_of_several_files_go_by_name(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k\tfirst\nz\tonly\n")
    (tmp_path / "b.txt").write_text("k\tlast\n" + "".join(f"x{i}\tlong line {i}\n" for i in range(5000)))
    rows = readers.numbered(readers.lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(5003)) and [r.value for r in rows[:3]] == ["k\tfirst", "z\tonly", "k\tlast"]
    got = {r["id"]: r["value"] for r in readers.read_id_values(spark, str(tmp_path)).collect()}
    assert got["k"] == "last" and len(got) == 5002
    assert [r.value for r in readers.lines(spark, str(tmp_path), max_lines=3).orderBy("line_no").collect()] == ["k\tfirst", "z\tonly", "k\tlast"]


def test_blocks_of_several_files(spark, tmp_path):
    block = "product/productId: {}\nproduct/description: {}\n\n"
    (tmp_path / "a.txt").write_text(block.format("A", "old") + block.format("B", "only"))
    (tmp_path / "b.txt").write_text("".join(block.format(f"x{i}", i) for i in range(300)) + block.format("A", "new"))
    assert {r["id"]: r["value"] for r in readers.read_descriptions(spark, str(tmp_path)).where("id in ('A', 'B')").collect()} == {"A": "new", "B": "only"}
    few = readers.read_descriptions(spark, str(tmp_path), max_lines=8)
    assert {r["id"]: r["value"] for r in few.collect()} == {"A": "old", "B": "only", "x0": "0"}
    folder = tmp_path / "categories"
    folder.mkdir()
    (folder / "a.txt").write_text("A\n  Books\nB\n")
    (folder / "b.txt").write_text("  Music\n" + "".join(f"y{i}\n  p{i}\n" for i in range(400)))
    got = {r["id"]: r["paths"] for r in readers.read_categories(spark, str(folder)).collect()}
    assert got["A"] == ["Books"] and got["B"] == ["Music"] and got["y399"] == ["p399"]


def test_written_lines_keep_their_order(spark, tmp_path):
    rows = spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("value"))
    sinks.write_lines(rows, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*"))) == 5
    assert [r.value for r in readers.numbered(readers.lines(spark, str(tmp_path / "w"))).orderBy("line_no").collect()] == [str(i) for i in range(1000)]


def test_stored_files_join_without_exchange(spark):
    ids = spark.range(300).select("id", F.concat(F.lit("v"), "id").alias("value"))
    paths = spark.range(0, 300, 2).select("id", F.array(F.lit("a, b")).alias("paths"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        d, t, c, b = catalog.stored(ids, ids.where("id % 3 = 0"), paths, ids.where("id % 5 = 0"), buckets=4)
        rows = catalog.assemble(d, t, c, b)
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.id, r.brand) for r in rows.collect()) == [(i, f"v{i}" if i % 5 == 0 else "") for i in range(0, 300, 6)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_overlaps_are_counted_where_products_meet(spark):
    from pyspark.sql import functions as F

    from listingloom.operators import overlap

    rows = spark.range(40).select("id", F.concat(F.lit("b"), F.col("id") % 3).alias("brand"), F.lit("c").alias("cat"), F.transform(F.sequence(F.col("id") % 5, F.col("id") % 5 + 6), lambda t: t.cast("long")).alias("_tokens"))
    made = overlap.band_join(rows, "cat", 0.5, 0.9)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # no pair is joined to its products again, and the counts of tokens are not broadcast
    assert not [x for x in plan.splitlines() if "Join" in x and ("_i#" in x or "_j#" in x)]
    assert "rightHint=(strategy=merge)" in plan
    sets = {r.id: (r.brand, set(r._tokens)) for r in rows.collect()}
    share = lambda i, j: len(sets[i][1] & sets[j][1]) / len(sets[i][1] | sets[j][1])
    want = [(i, j, share(i, j)) for i in sets for j in sets if i < j and sets[i][0] != sets[j][0] and 0.5 <= share(i, j) < 0.9]
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_sample_of_many_is_the_sample(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("x"))
    want = sorted(map(tuple, sampling.sample(df, 50, 42, "id", "x").collect()))
    # the count may be far off; a bound that keeps too few is not believed
    for count in (0, 200, 20_000, 40_000, 10_000_000, 10**15):
        assert sorted(map(tuple, sampling.sample_of_many(df, 50, count, 42, "id", "x").collect())) == want
