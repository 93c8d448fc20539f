"""Joins, decontamination and neighbours against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingloom.llm import decontaminate, nearest, shingle_join
from listingloom.llm.common import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(t):
    w = WORDS.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(base_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [f"n{rng.randint(0, 10**6)}"], [w[k], w[k]]])
        out.append(" ".join(w))
    return out


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.components(df).collect()), key=str)


def test_join_of_all_sizes(spark, documents):
    texts = [t for k, n in enumerate([3, 5, 11, 12, 13, 14, 17, 19, 20, 21, 22, 24, 25, 40, 90, 150, 300]) for t in near_copies(k, n, 12, 4)]
    texts += [None, "", " \t\n", "one", "ONE", "one two", "One  TWO", "É é x", "é é x", "a b c a b c a b c", "a b c a b c"]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(documents(rows)) == brute(rows)


def test_join_with_repeats_null_ids_and_nothing(spark, documents):
    t = near_copies(7, 60, 3, 1)
    rows = [(5, t[0]), (5, t[0]), (2, t[1]), (None, t[0]), (9, "alone in here"), (None, "lonely null row"), (3, None)]
    assert joined(documents(rows)) == brute(rows)
    assert shingle_join.components(documents([])).count() == 0
    kept = shingle_join.keep_first(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(i, x) for i, x in {(2, t[1]), (9, "alone in here"), (None, "lonely null row"), (3, None), (None, t[0])}], key=str
    )


def test_large_cluster_is_cut_into_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(shingle_join, "CHUNK", 1500)
    monkeypatch.setattr(shingle_join, "LEAST_SET", 16)
    monkeypatch.setattr(shingle_join, "FREQUENT", 8)
    rows = list(enumerate(near_copies(3, 80, 150, 3)))
    assert joined(documents(rows)) == brute(rows)


def test_chains_of_phrases_bring_no_whole_sets_together(spark, documents):
    # each text shares a phrase with the next one: all are chained, next to none are near
    phrase = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(41)]
    apart = [f"{phrase[k]} {phrase[k + 1]} " + " ".join(f"w{k}x{i}" for i in range(70)) for k in range(40)]
    rows = list(enumerate(apart + near_copies(5, 150, 6, 2)))
    described, nodes = shingle_join.named(shingle_join.materialize(shingle_join.describe(documents(rows), 11), "described"))
    wide = shingle_join.clusters(shingle_join.candidates(described)).count()
    assert wide >= 30 and shingle_join.near_clusters(described, nodes).count() <= 16


def test_rows_without_ids_carry_links(spark, documents):
    base = [f"w{i}" for i in range(120)]
    bridge = [*base[:60], "a", "b", *base[62:]]
    far = [*bridge[:20], "c", "d", *bridge[22:]]
    rows = [(4, " ".join(base)), (None, " ".join(bridge)), (None, " ".join(bridge)), (9, " ".join(far)), (11, "other words here")]
    want = brute(rows)
    assert (9, 118, 4) in want and (4, 118, 4) in want and joined(documents(rows)) == want


def test_sets_of_one_sum_stay_apart(spark, documents, monkeypatch):
    rows = list(enumerate(near_copies(11, 40, 6, 4) + near_copies(12, 9, 6, 1)))
    df = documents(rows)
    made = shingle_join.describe(df, 11).withColumn("s1", F.col("s1") % 3)
    described, nodes = shingle_join.named(made)
    assert described.select("node").distinct().count() == made.select("s1", "s2", "n").distinct().count() == nodes.count()


@pytest.mark.parametrize("small", [1, 11, 29])
def test_the_boundary_changes_no_link(spark, documents, monkeypatch, small):
    monkeypatch.setattr(shingle_join, "measured_boundary", lambda docs: small)
    rows = list(enumerate(t for k, n in enumerate([5, 11, 13, 20, 24, 29, 31, 34, 60]) for t in near_copies(20 + k, n, 6, 4)))
    assert joined(documents(rows)) == brute(rows)


def test_boundary_is_the_cheapest():
    def cost(b, sizes, shared):
        entry = shingle_join.ENTRY_COST + shingle_join.SHARED_COST * shared
        by_subsets = sum(c * shingle_join.SUBSET_COST * shingle_join.subsets(n) for n, c in sizes.items() if n <= b)
        return by_subsets + sum(c * entry * shingle_join.listed(n) for n, c in sizes.items() if 10 * n >= 9 * (b + 1))

    for sizes, shared in (({8: 50, 14: 9, 300: 4}, 0.0), ({8: 50, 14: 9, 300: 4}, 1.0), ({19: 5, 25: 1}, 0.4), ({}, 0.0)):
        b = shingle_join.boundary(sizes, shared)
        assert cost(b, sizes, shared) == min(cost(x, sizes, shared) for x in range(1, shingle_join.MOST_SMALL + 1))
    assert shingle_join.boundary({10: 10}, 0.0) < 10 <= shingle_join.boundary({10: 10}, 1.0)


def test_frequent_keys_are_met_by_a_broadcast(spark, monkeypatch):
    from listingloom.llm import common

    rows = spark.range(100).selectExpr("id", "id % 7 * (id % 2) as k")
    of = rows.groupBy("k").agg(F.min("id").alias("m"), F.count("*").alias("_rows"))
    for most in (1, 10, 1000):
        monkeypatch.setattr(common, "MOST_OF_A_KEY", most)
        got = sorted(map(tuple, common.meet(rows, of, ["k"], 100).collect()))
        assert got == sorted(map(tuple, rows.join(of.drop("_rows"), "k").collect()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 5), (7, 7), (8, 1)] + [(i, i + 1) for i in range(100, 140)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 4: 4, 5: 4, 6: 4} | {i: 100 for i in range(100, 141)}
    assert connected_components(df.limit(0), "t").count() == 0


def test_components_of_few_edges_take_few_tasks_and_rounds(spark, monkeypatch):
    from listingloom.llm import common

    written, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: written.append(write(df, label)) or written[-1])
    monkeypatch.setattr(common, "discard", lambda df: None)
    order = random.Random(5).sample(range(3000), 3000)
    df = spark.createDataFrame(list(zip(order[:-1], order[1:])), "a long, b long").repartition(5)
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert {(r["node"], r["component"]) for r in connected_components(df, "t").collect()} == {(i, 0) for i in range(3000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) <= 4 and all(len(w.inputFiles()) == 1 for w in written[1:])


def test_contracted_edges_keep_components(spark, monkeypatch):
    from listingloom.llm import common

    draw = random.Random(3)
    edges = [(draw.randrange(900), draw.randrange(900)) for _ in range(500)]
    monkeypatch.setattr(common, "ROWS_OF_A_TASK", 60)
    monkeypatch.setattr(common, "EDGES_AT_ONCE", 25)
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    least = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert {r["node"]: r["component"] for r in connected_components(df, "t").collect()} == least


def brute_leaks(docs, items):
    split = {i: decontaminate.words_of(t) for i, t in items}
    bags = {i: Counter(tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)) for i, w in split.items() if w}
    out = set()
    for d, t in docs:
        w = decontaminate.words_of(t)
        for i, bag in bags.items():
            n = len(split[i])
            k = min(5, n)
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            for at in range(max(1, len(w) - n + 1)):
                own = Counter(grams[at : at + n - k + 1])
                low = sum(min(c, own[h]) for h, c in bag.items())
                high = sum(max(bag[h], own[h]) for h in {*bag, *own})
                if low and low / high >= 0.8 - 1e-12:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("block", [(16 << 20, 4000, 8192), (200, 4000, 8192), (16 << 20, 3, 10)])
def test_decontamination(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "STRETCH", block[2])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block[0])
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block[1])
    rng = random.Random(4)
    word = lambda: f"v{rng.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 35, 20, 12, 5, 3, 1])] + [(50, None), (51, ""), (52, "...")]
    items += [(60, items[0][1] + " " + word()), (61, items[1][1])]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 120))]
        passage = items[rng.randrange(6)][1].upper().split()
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = word()
        if i % 3:
            w[len(w) // 2 : len(w) // 2] = [p + "," for p in passage]
        docs.append((i, " ".join(w)))
    docs += [(70, None), (71, ""), (72, items[2][1]), (72, items[2][1]), (None, items[3][1]), (73, ("filler " * 20000) + items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(documents(docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items)
    assert sum(r["doc_id"] == 72 and r["item_id"] == 2 for r in got) == 2
    kept = decontaminate.keep_clean(documents(docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in brute_leaks(docs, items)}
    assert decontaminate.find_leaks(documents([]), bench).count() == 0 and decontaminate.find_leaks(documents(docs), bench.limit(0)).count() == 0


def test_the_index_names_all_within_the_radius_and_few_others():
    rng = np.random.default_rng(5)
    bench = decontaminate.Benchmark([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))) for i in range(300)])
    flips = np.packbits(rng.random((300, 128)) < rng.random((300, 1)) * 0.3, axis=1)
    prints = np.concatenate([bench.prints ^ flips, rng.integers(0, 256, (300, 16)).astype(np.uint8)])
    w, n = bench.candidates(prints, 60)
    distance = np.bitwise_count(prints[:, None] ^ bench.prints[None]).sum(axis=2, dtype=int)
    assert set(zip(w.tolist(), n.tolist())) == set(map(tuple, np.argwhere(distance <= decontaminate.RADIUS).tolist()))
    # of pairs of chance about one in twelve is looked at
    looked = sum(int(count[v].sum()) for (_, count, _), v in zip(bench.index, prints[300:].view(np.uint16).T))
    assert looked < 0.12 * 300 * 300


def test_near_copies_of_repeated_items_are_leaks(spark, documents):
    item = [f"w{i}" for i in range(60)]
    doc = [*item[:30], "other", *item[31:]]
    bench = spark.createDataFrame([(i, " ".join(item)) for i in range(5)], "item_id long, text string")
    got = decontaminate.find_leaks(documents([" ".join(doc)]), bench).collect()
    assert {r["item_id"] for r in got} == set(range(5)) and all(abs(r["similarity"] - 51 / 61) < 1e-9 for r in got)


VECTORS = "vec_id long, embedding array<float>, label int, bucket string"


def exact(rows, k, asked, length=16):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == length:
            ok[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for i in ids:
        if asked(i):
            d = np.sqrt(((x - ok[i]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist(), 0, "b") for i in range(500)]
    rows += [(1000 + i, rows[0][1], 0, "b") for i in range(30)]
    rows += [rows[3], (2000, None, 0, "b"), (2001, [0.0] * 16, 0, "b"), (2002, [float("nan")] + [1.0] * 15, 0, "b"), (2003, [None] + [1.0] * 15, 0, "b"), (2004, [1.0] * 3, 0, "b"), (None, rows[1][1], 0, "b"), (2005, [float("inf")] * 16, 0, "b")]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows, 10, lambda i: i % 10 == 0)
    assert got.keys() == want.keys()
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    for q, pairs in got.items():
        assert pairs == sorted(pairs, key=lambda p: (p[1], p[0])) and q not in {v for v, _ in pairs}
        assert all(abs(s - dict(want[q]).get(v, s)) < 1e-12 for v, s in pairs)
    assert got[1000][:10] == want[1000][:10]


def test_neighbours_of_two_scales(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.002 * rng.normal(size=16) if i < 600 else 4 * rng.normal(size=16)).astype(np.float32).tolist(), 0, "b") for i in range(1000)]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: {v for v, _ in near} for q, near in exact(rows, 10, lambda i: i % 10 == 0).items()}
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    for part in (range(0, 600), range(600, 1000)):
        assert np.mean([len(got[q] & want[q]) / 10 for q in want if q in part]) >= 0.9


def neighbours(spark, rows, k=10):
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_all_candidates_are_returned_where_few_exist(spark):
    rng = np.random.default_rng(3)
    far = [(i * 50, (100 * rng.normal(size=16)).astype(np.float32).tolist(), 0, "b") for i in range(8)]
    got = neighbours(spark, far)
    assert got.keys() == {0, 100, 200, 300} and {q: [v for v, _ in near] for q, near in got.items()} == {q: [v for v, _ in near] for q, near in exact(far, 10, lambda i: i % 100 == 0).items()}


@pytest.mark.parametrize("most", [50_000, 3])
def test_ten_are_returned_from_groups_of_five(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "MOST_HELD", most)
    rng = np.random.default_rng(4)
    centres = 50 * rng.normal(size=(80, 16))
    rows = [(i * 20, (centres[i % 80] + 0.01 * rng.normal(size=16)).astype(np.float32).tolist(), 0, "b") for i in range(400)]
    got, want = neighbours(spark, rows), exact(rows, 10, lambda i: i % 100 == 0)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_recall_on_the_embeddings(spark):
    from listingloom.llm import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {}
    for r in queries.op10_nearest(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows, 10, lambda i: i % 100 == 0, 64)
    assert got.keys() == want.keys() and np.mean([len(got[q] & {v for v, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_few_or_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 0, "b"), (1, [1.0, 2.5], 0, "b")], VECTORS)
    assert [tuple(r) for r in nearest.search(one, F.col("vec_id") % 100 == 0, 10).collect()] == [(0, 1, 1, 0.5)]
    assert nearest.search(one.limit(0), F.lit(True), 10).count() == 0


def test_probe_order_is_by_cost():
    inside = np.array([[0.1, 0.45, 0.8], [0.5, 0.5, 0.5]])
    for row, moves in zip(inside, nearest.probe_order(inside, 27)):
        cost = [sum(row[i] ** 2 if d < 0 else (1 - row[i]) ** 2 for i, d in enumerate(p) if d) for p in moves]
        assert cost == sorted(cost) and len({tuple(p) for p in moves.tolist()}) == 27 and not moves[0].any()
