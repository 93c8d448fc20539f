"""Synthetic pairs: variants, rewordings, alternatives and unrelated pairs from products.

Random draws are md5 ranks: quotas, uniqueness, class mix and overlap bands hold, and
the same rows come out at any parallelism. Pairs of a block are met by a join and cut by
rank before they are widened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import OTHER, swap_attribute
from ..functions.similarity import jaccard, let, token_ids
from ..functions.text import candidate_text, md5_order, text
from ..sources.sinks import written
from .dedupe import stack
from .overlap import band_join
from .pairs import ALTERNATIVE_OVERLAP, FIELDS, blocked_pairs, cross_brand_lenient, cross_brand_strict, flat, group_gate, met_in_blocks, prepare
from .sampling import numbered, sample

WEAK_OVERLAP = 0.05
#: Products that a task orders in a draw.
RUN = 100_000


def draw(seed: int | str, *key: str | Column) -> Column:
    """A whole number from the md5 of a key."""
    return F.conv(F.substring(md5_order(seed, *key), 1, 8), 16, 10).cast("long")


def pick(values: Column, seed: int | str, *key: str | Column) -> Column:
    return F.get(values, F.pmod(draw(seed, *key), F.size(values)).cast("int"))


def _pair(products: DataFrame, other_id: Column, other_title: Column, other_description: Column, label: str) -> DataFrame:
    return products.select(
        F.col("id").cast("string").alias("product1_id"), F.col("title").alias("product1_title"), F.col("brand").alias("product1_brand"), F.col("description").alias("product1_description"),
        other_id.alias("product2_id"), other_title.alias("product2_title"), F.col("brand").alias("product2_brand"), other_description.alias("product2_description"),
        F.lit(label).alias("relationship_label"), F.lit("synthetic").alias("source"),
    )


def variant_pairs(products: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A product and itself with one attribute swapped."""
    made = products.withColumn("_s", swap_attribute("title", "description", draw(f"{seed}-swap", "id"))).where(F.col("_s").isNotNull())
    made = sample(made, n, seed, "id")
    return _pair(made, F.concat("id", F.lit("-variant-"), F.col("_s.attribute")), F.col("_s.title"), F.col("_s.description"), "SAME_PRODUCT_DIFFERENT_VARIANT")


def exact_pairs(products: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A product and itself with the brand moved about in the title."""
    rows = products.where((text("brand") != "") & F.contains(F.lower("title"), F.lower("brand")))
    rows = sample(rows, n, seed, "id")
    bare = F.regexp_replace(F.replace(F.col("title"), F.col("brand"), F.lit("")), "^[ ,-]+|[ ,-]+$", "")
    b = F.col("brand")
    said = pick(F.array(F.concat(bare, F.lit(" by "), b), F.concat(bare, F.lit(" - "), b), F.concat(b, F.lit(": "), bare)), f"{seed}-words", "id")
    return _pair(rows, F.concat("id", F.lit("-reworded")), said, F.col("description"), "EXACT_MATCH")


def _cross(pairs: DataFrame, lenient: bool) -> DataFrame:
    """The cross-brand pairs, with their ids."""
    cross = cross_brand_lenient if lenient else cross_brand_strict
    return pairs.where(cross(F.col("a.brand"), F.col("b.brand"))).withColumn("_i", F.col("a.id")).withColumn("_j", F.col("b.id"))


def _widened(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """pairs (_i, _j and more) with all columns of both products as a and b: texts are met by chosen pairs alone."""
    whole = F.struct(*products.columns)
    for key, name in (("_i", "a"), ("_j", "b")):
        pairs = pairs.join(products.select(F.col("id").alias(key), whole.alias(name)), key)
    return pairs


def drawn(products: DataFrame, by: str, rounds: int, seed: int | str) -> DataFrame:
    """(a, b): in each round every product with the next one of its group in a new md5 order; a.id < b.id, each pair once.

    Neighbours in a random order are random pairs: a round gives about as many as there are
    products, from all of them, and large groups are dealt to buckets of RUN products.
    """
    from pyspark.sql import Window

    buckets = max(1, products.count() // RUN)
    rows = products.select(F.col(by).alias("_by"), F.struct(*products.columns).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_round"))
    rows = rows.withColumn("_o", md5_order(f"{seed}-draw", "_round", "a.id"))
    rows = rows.withColumn("_bucket", F.pmod(F.conv(F.substring("_o", 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    met = rows.withColumn("b", F.lead("a").over(Window.partitionBy("_by", "_round", "_bucket").orderBy("_o", "a.id"))).where(F.col("b").isNotNull() & (F.col("a.id") != F.col("b.id")))
    ahead = F.col("a.id") < F.col("b.id")
    met = met.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"))
    return met.withColumn("_i", F.col("a.id")).withColumn("_j", F.col("b.id")).dropDuplicates(["_i", "_j"]).select("a", "b")


def band_pairs(products: DataFrame, low: float, high: float, n: int, label: str, seed: int = 42, rounds: int = 4) -> DataFrame:
    """n cross-brand pairs of one derived category with low <= overlap < high, or all if fewer.

    They are drawn from random pairs of all products. Only where those do not hold n, all pairs
    of the band are found by an inverted index of the tokens.
    """
    prepared = prepare(products).where(F.col("_category") != OTHER)
    narrow = prepared.select("id", "brand", "_category", "_tokens")
    overlap = jaccard(F.col("a._tokens"), F.col("b._tokens"))
    inside = lambda pairs: _cross(pairs, lenient=False).where(let(overlap, lambda o: (o >= low) & (o < high))).select("_i", "_j")
    pairs = written(inside(drawn(narrow, "_category", rounds, seed)), "drawn")
    if pairs.limit(n).count() < n:
        pairs = band_join(narrow, "_category", low, high).select("_i", "_j")
    chosen = _widened(sample(pairs, n, seed, "_i", "_j"), products.select(*FIELDS))
    return flat(chosen, F.lit(label).alias("relationship_label"), F.lit("synthetic").alias("source"))


def uniform_pairs(products: DataFrame, by: str, n: int, seed: int | str = 42) -> DataFrame:
    """(draw, a, b): n draws, each of a group of `by` (every one as likely) and of two different products of it.

    A product's address is its group and its place there; a draw is two addresses, met by
    joins. Groups of one product and null groups are passed over; a pair may be drawn again.
    """
    from pyspark.sql import Window

    rows = products.where(F.col(by).isNotNull())
    groups = rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    count = groups.count()
    # a row for each group
    groups = groups.withColumn("_group", F.row_number().over(Window.orderBy("_by")) - 1)
    places = numbered(rows, f"{seed}-place", "id", by=by, name="_place").select(F.col(by).alias("_by"), "_place", F.struct(*products.columns).alias("x"))
    draws = products.sparkSession.range(n if count else 0).withColumnRenamed("id", "draw").withColumn("_group", F.pmod(draw(f"{seed}-group", "draw"), F.lit(max(1, count))))
    draws = draws.join(groups, "_group").withColumn("_a", F.pmod(draw(f"{seed}-first", "draw"), "_size")).withColumn("_b", F.pmod(draw(f"{seed}-second", "draw"), F.col("_size") - 1))
    draws = draws.withColumn("_b", F.col("_b") + (F.col("_b") >= F.col("_a")).cast("int"))
    for at, name in (("_a", "a"), ("_b", "b")):
        draws = draws.join(places.select("_by", F.col("_place").alias(at), F.col("x").alias(name)), ["_by", at])
    return draws.select("draw", "a", "b")


def uniform_band_pairs(products: DataFrame, low: float, high: float, n: int, label: str, seed: int = 42, attempts: int = 30) -> DataFrame:
    """The first n different cross-brand pairs with low <= overlap < high among attempts * n draws
    that take each derived category as often as any other."""
    narrow = prepare(products).select("id", "brand", "_category", "_tokens")
    met = uniform_pairs(narrow, "_category", attempts * n, seed)
    met = met.where(cross_brand_strict(F.col("a.brand"), F.col("b.brand")) & let(jaccard(F.col("a._tokens"), F.col("b._tokens")), lambda o: (o >= low) & (o < high)))
    once = met.groupBy(F.least("a.id", "b.id").alias("_i"), F.greatest("a.id", "b.id").alias("_j")).agg(F.min("draw").alias("_draw"))
    chosen = _widened(once.orderBy("_draw").limit(n), products.select(*FIELDS))
    return flat(chosen, F.lit(label).alias("relationship_label"), F.lit("synthetic").alias("source"))


def alternative_pairs(products: DataFrame, n: int = 280, seed: int = 42) -> DataFrame:
    return band_pairs(products, ALTERNATIVE_OVERLAP, 0.55, n, "SIMILAR_ALTERNATIVE", seed)


def weak_pairs(products: DataFrame, n: int = 280, seed: int = 43) -> DataFrame:
    return band_pairs(products, WEAK_OVERLAP, ALTERNATIVE_OVERLAP, n, "WEAKLY_SIMILAR", seed)


def synthesize(products: DataFrame, existing: DataFrame, n: int = 280) -> DataFrame:
    """Variants, alternatives and weak pairs beside the existing rows."""
    products = products.withColumn("id", F.col("id").cast("string"))
    return stack([existing, variant_pairs(products, n), alternative_pairs(products, n), weak_pairs(products, n)])


def percentile_pairs(
    products: DataFrame, category: str = "category", pool: int = 500, least: int = 5, alternative: float = 0.9, weak: float = 0.5,
    n_alternative: int = 5000, n_weak: int = 5000, seed: int = 42, least_pool: int = 10, rounds: int = 12, small: int = 64,
) -> DataFrame:
    """Per real category the top of its own overlap distribution is an alternative, the next
    band weakly similar. Cut-offs are exact percentiles of a pool of cross-brand pairs.

    The pool is all pairs of a category of up to `small` products, else random pairs of all its
    products. Where those are fewer than `pool`, nearly all products are of one brand, and all
    cross-brand pairs are listed: those of the products of other brands with all.
    """
    from pyspark.sql import Window

    rows = group_gate(products, category, least).withColumn("_block", F.col(category))
    sizes = rows.groupBy("_block").count()
    narrow = rows.select("id", "brand", "_block")
    few = narrow.join(sizes.where(F.col("count") <= small), "_block", "left_semi")
    many = narrow.join(sizes.where(F.col("count") > small), "_block", "left_semi")
    met = written(_cross(drawn(many, "_block", rounds, seed), lenient=True), "drawn")
    enough = met.groupBy(F.col("a._block").alias("_block")).count().where(F.col("count") >= pool).select("_block")
    pools = [met, _cross(blocked_pairs(few, ["_block"]), lenient=True)]
    if not sizes.where(F.col("count") > small).join(enough, "_block", "left_anti").isEmpty():
        brand = F.lower(F.trim(text("brand")))
        one_sided = many.join(enough, "_block", "left_anti").withColumn("_brand", brand)
        usual = one_sided.groupBy("_block", "_brand").count().groupBy("_block").agg(F.max_by("_brand", F.struct("count", "_brand")).alias("_usual"))
        one_sided = one_sided.join(usual, "_block")
        odd = one_sided.where((F.col("_brand") != F.col("_usual")) | (F.col("_brand") == ""))
        rest = met_in_blocks(odd.select(*many.columns), one_sided.select(*many.columns), ["_block"]).where("x.id <> y.id")
        ahead = F.col("x.id") < F.col("y.id")
        rest = rest.select(F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("b"))
        rest = _cross(rest, lenient=True).dropDuplicates(["_i", "_j"])
        pools = [met.join(enough.withColumnRenamed("_block", "_e"), F.col("a._block") == F.col("_e"), "left_semi"), rest, pools[1]]
    pairs = stack(pools)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(md5_order(seed, "_i", "_j"), "_i", "_j"))
    pooled = pairs.select(F.col("a._block").alias("_b"), "_i", "_j").withColumn("_r", rank).where(F.col("_r") <= pool)
    # tokens are only made for products of the pools
    pooled = _widened(pooled, rows.select(*FIELDS)).withColumn("overlap", jaccard(token_ids(candidate_text("a.title", "a.description")), token_ids(candidate_text("b.title", "b.description"))))
    # read three times below: `pool` rows a category
    pooled = written(pooled, "pool")
    cuts = pooled.groupBy("_b").agg(F.percentile("overlap", F.lit(alternative)).alias("_alt"), F.percentile("overlap", F.lit(weak)).alias("_weak"), F.count(F.lit(1)).alias("_n"))
    labelled = pooled.join(cuts.where(F.col("_n") >= least_pool), "_b").withColumn(
        "_label", F.when(F.col("overlap") >= F.col("_alt"), "SIMILAR_ALTERNATIVE").when(F.col("overlap") >= F.col("_weak"), "WEAKLY_SIMILAR")
    )
    parts = [sample(labelled.where(F.col("_label") == name), n, seed, "_i", "_j") for name, n in (("SIMILAR_ALTERNATIVE", n_alternative), ("WEAKLY_SIMILAR", n_weak))]
    return flat(stack(parts), F.col("_label").alias("relationship_label"), F.lit("synthetic").alias("source"))


def unrelated_pairs(products: DataFrame, n: int, category: str = "category", seed: int = 42, rounds: int = 4) -> DataFrame:
    """n pairs across categories: in each round products in md5 order, each with the next one.

    Neighbours in a random order are random pairs, so no product meets all others; pairs
    within one category are passed over. Where the rounds do not hold n, nearly all products
    are of one category: those of the others also meet n products of it each.
    """
    from .pairs import consecutive

    fields = ["id", "title", "brand", "description", category]
    rows = products.where(F.col(category).isNotNull())
    across = F.col(f"product1_{category}") != F.col(f"product2_{category}")
    pairs = stack([consecutive(rows, f"{seed}-{i}", ["id"], fields) for i in range(rounds)]).where(across).dropDuplicates(["product1_id", "product2_id"])
    if pairs.limit(n).count() < n:
        usual = rows.groupBy(category).count().orderBy(F.desc("count"), category).limit(1).select(F.col(category).alias("_usual"))
        own = F.col(category) == F.col("_usual")
        odd = rows.select(*fields, F.lit(0).alias("_all")).join(F.broadcast(usual), own, "left_anti")
        some = sample(rows.select(*fields, F.lit(0).alias("_all")).join(F.broadcast(usual), own, "left_semi"), n, seed, "id")
        # n products of the usual category at most; both sides are dealt in chunks
        more = met_in_blocks(odd, some, ["_all"])
        pairs = stack([pairs, more.select(*[F.col(s)[f].alias(f"product{k}_{f}") for s, k in (("x", 1), ("y", 2)) for f in fields])]).dropDuplicates(["product1_id", "product2_id"])
    chosen = sample(pairs, n, seed, "product1_id", "product2_id")
    return chosen.drop(f"product1_{category}", f"product2_{category}").withColumns({"relationship_label": F.lit("UNRELATED"), "source": F.lit("synthetic")})


def generate_catalog(products: DataFrame, n: int = 5000, category: str = "category") -> DataFrame:
    """All five classes from a catalog, up to n rows each."""
    products = products.withColumn("id", F.col("id").cast("string"))
    parts = [exact_pairs(products, n), variant_pairs(products, n), percentile_pairs(products, category, n_alternative=n, n_weak=n), unrelated_pairs(products, n, category)]
    return stack(parts)
