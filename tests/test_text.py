"""Scalar functions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from listingloom import schemas
from listingloom.functions import attributes, similarity, text

ODD = ["128 GB ssd 6.7 inch", "café128gb x", "8 GB RAM and 8GB RAM and 8gb ram", "8gb rampage 16 gb storage", "M2 Pro, core i7 ryzen 5", "12345gb",
       "50 in stock", "rose gold", "titanium gray", "covered", "", None, "   ", "1TB SSD, 8GB RAM. 32GB RAM", "a b", "Élan 5 GB", "x" * 5000]


def plain_clean(s):
    s = "" if s is None else s.strip().lower()
    s = re.sub(r"(\d)\s*(" + "|".join(schemas_units()) + r")\b", r"\1\2", s)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9.\-\s]", " ", s)).strip()


def schemas_units():
    return text.UNITS


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string")


def test_clean_text(odd):
    for r in odd.select("s", text.clean_text("s").alias("c")).collect():
        assert r["c"] == plain_clean(r["s"]), r["s"]


def test_tokens_and_jaccard(odd):
    rows = odd.select("s", similarity.tokens("s").alias("t")).collect()
    for r in rows:
        assert set(r["t"]) == set(re.findall("[a-z0-9]+", (r["s"] or "").lower()))
    pairs = odd.alias("a").crossJoin(odd.alias("b")).select(F.col("a.s").alias("x"), F.col("b.s").alias("y"), similarity.token_overlap(F.col("a.s"), F.col("b.s")).alias("j"))
    for r in pairs.collect():
        x, y = (set(re.findall("[a-z0-9]+", (r[c] or "").lower())) for c in "xy")
        assert r["j"] == (len(x & y) / len(x | y) if x and y else 0.0)


def test_attributes_first_colour_in_list_order(odd):
    got = {r["s"]: r["a"] for r in odd.select("s", attributes.extract_attributes("s").alias("a")).collect()}
    assert got["rose gold"]["color"] == "gold" and got["titanium gray"]["color"] == "gray" and got["covered"]["color"] == "red"
    assert got["8gb rampage 16 gb storage"]["storage"] == "16gb" and got["8gb rampage 16 gb storage"]["ram"] is None
    assert got["8 GB RAM and 8GB RAM and 8gb ram"]["ram"] == "8" and got[""]["color"] is None


def test_swap_changes_one_attribute(spark):
    df = spark.createDataFrame([("Red shoe", "rendered"), ("Phone 8GB RAM", None), ("plain", "thing")], "t string, d string")
    rows = df.select(attributes.swap_attribute("t", "d", F.lit(5)).alias("s")).collect()
    assert rows[0]["s"]["attribute"] == "color" and "red" not in rows[0]["s"]["title"]
    assert rows[1]["s"]["attribute"] == "ram" and rows[1]["s"]["description"] is None
    assert rows[2]["s"] is None


def test_product_text_skips_empty_parts(spark):
    df = spark.createDataFrame([("A 8 GB", "", None, "d"), (None, None, None, None)], "t string, b string, s string, d string")
    assert [r[0] for r in df.select(text.product_text("t", "b", "s", "d")).collect()] == ["a 8gb | d", ""]


def test_format_time(spark):
    df = spark.createDataFrame([(3723.9,), (123.0,), (3.0,), (-5.0,)], "s double")
    assert [r[0] for r in df.select(text.format_time("s")).collect()] == ["1h 02m 03s", "2m 03s", "3s", "0s"]


def test_detect_schema():
    assert schemas.detect_schema(schemas.FULL.fieldNames()) == "full"
    assert schemas.detect_schema(["product1", "product2", "label"]) == "title_only"
    with pytest.raises(schemas.SchemaError):
        schemas.detect_schema(["x"])


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    r = df.select(text.argmax("z").alias("a"), F.aggregate(text.softmax("z"), F.lit(0.0), lambda a, x: a + x).alias("s")).first()
    assert r["a"] == 1 and abs(r["s"] - 1) < 1e-12


def test_encode_pair(spark):
    from listingloom.functions.encoding import encode_pair

    def plain(a, b, length):
        """Pieces go one by one from the longer text, from the second of equally long ones."""
        import hashlib
        import re

        u, v = [[4 + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (32_768 - 4) for w in re.findall(r"[a-z0-9]+|[^a-z0-9\s]", (t or "").lower())] for t in (a, b)]
        while len(u) + len(v) > length - 3:
            (u if len(u) > len(v) else v).pop()
        ids = [1, *u, 2, *v, 2]
        rest = [0] * (length - len(ids))
        return ids + rest, [0] * (len(u) + 2) + [1] * (len(v) + 1) + rest, [1] * len(ids) + rest

    texts = [("a b c", "d"), (None, ""), ("x " * 9, "y " * 9), ("x " * 40, "y!"), ("", "y " * 40), ("Word-by-word 5.3", "a a a a a a a a a")]
    for length in (3, 4, 9, 12):
        rows = spark.createDataFrame(texts, "a string, b string").select("a", "b", encode_pair("a", "b", length).alias("x")).collect()
        for r in rows:
            assert (list(r.x.input_ids), list(r.x.token_type_ids), list(r.x.attention_mask)) == plain(r.a, r.b, length)


def test_vocabulary_against_a_count(spark):
    from collections import Counter

    from listingloom.operators import vocabulary

    texts = [(1, "b a a, c"), (2, None), (3, ""), (4, "A b! d"), (5, "a " * 500)]
    df = spark.createDataFrame(texts, "id int, t string")
    split = {i: vocabulary_words(t) for i, t in texts}
    counts = Counter(w for words in split.values() for w in words)
    best = sorted(counts, key=lambda w: (-counts[w], w))
    for size in (5, 6, 100):
        words = vocabulary.learn(df, "t", size)
        ids = {w: k + 4 for k, w in enumerate(best[: size - 4])}
        assert {r.piece: (r.id, r["count"]) for r in words.collect()} == {w: (k, counts[w]) for w, k in ids.items()}
        assert {r.id: list(r.ids) for r in vocabulary.encode(df, "id", "t", words).collect()} == {i: [ids.get(w, 3) for w in ws] for i, ws in split.items()}
        assert tuple(vocabulary.covered(df, "t", words).first()) == (len(counts), len(ids), sum(counts.values()), sum(counts[w] for w in ids))
    assert vocabulary.learn(df, "t", 100, least=2).count() == 2
    empty = vocabulary.learn(df.limit(0), "t")
    assert empty.count() == 0 and tuple(vocabulary.covered(df.limit(0), "t", empty).first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        vocabulary.learn(df, "t", 4)


def vocabulary_words(t):
    import re

    return re.findall(r"[a-z0-9]+|[^a-z0-9\s]", (t or "").lower())
