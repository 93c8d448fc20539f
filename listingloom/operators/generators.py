"""Labelled pairs made from a dimension table of product families.

A family is a row (category, brand, model, storages, colors, extras, and specs if it has a
column of them); the table is a parameter, so any catalog of families can be used, and
`families_of` makes one of a table of products. Combinations are joins and explodes; every
random choice is an md5 draw on the row's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedupe import stack, unordered_first
from .pairs import triangular
from .sampling import mix_sizes, numbered, sample
from .synth import draw, pick

FAMILY = "category string, brand string, model string, storages array<string>, colors array<array<string>>, extras array<string>"
#: category, storages, extras, spec words. Two spec words are drawn for a product.
CATEGORIES = [
    ("smartphone", ["64GB", "128GB", "256GB", "512GB"], ["with charger"], ["two-day battery", "dual speakers", "bright 120 Hz panel"]),
    ("laptop", ["256GB SSD", "512GB SSD", "1TB SSD"], ["with sleeve", "with dock"], ["backlit keys", "fanless body", "matte panel"]),
    ("tablet", ["64GB", "128GB"], ["with pen"], ["slim bezel", "four speakers", "kids mode"]),
    ("earbuds", [], ["with spare tips"], ["wind filter", "ten-hour charge", "in-ear detection"]),
    ("headphones", [], [], ["folding cups", "soft headband", "long cable"]),
    ("camera", [], ["body alone", "with zoom lens"], ["tilting screen", "silent shutter", "sealed body"]),
    ("monitor", [], ["with arm"], ["height stand", "thin frame", "low blue light"]),
    ("printer", [], [], ["duplex tray", "wireless setup", "quiet mode"]),
    ("drive", ["1TB", "2TB", "4TB"], [], ["shock guard", "short cable", "aluminium shell"]),
    ("watch", [], ["with second strap"], ["sapphire glass", "sleep log", "week-long charge"]),
    ("console", ["512GB", "1TB"], ["with two pads"], ["quiet fan", "disc slot", "wall mount"]),
    ("footwear", [], [], ["knitted upper", "wide toe box", "grippy sole"]),
    ("backpack", [], [], ["rain cover", "laptop pocket", "chest strap"]),
    ("kettle", [], [], ["keep-warm plate", "lid lock", "limescale filter"]),
    ("book", [], [], []),
]
_COLORS = [["Black", "Coal"], ["Blue", "Lagoon"], ["Silver", "Mist"], ["Green", "Fern"], ["Red", "Ember"]]
_FIRST, _SECOND, _SERIES = ["Au", "Bo", "Ke", "Lu", "Os"], ["rel", "dan", "stra", "mo", "vik"], ["Nova", "Slate", "Crest", "Pico"]


def made_families(brands: int = 5, models: int = 3) -> list[tuple]:
    """Families by rule: so many invented brands for each category and models for each brand.

    No two brands share a name, and the models of a brand differ by a number.
    """
    out = []
    for c, (category, storages, extras, _) in enumerate(CATEGORIES):
        for k in range(brands):
            n = c * brands + k
            brand = _FIRST[n % 5] + _SECOND[n // 5 % 5] + ("" if n < 25 else _SECOND[n // 25 % 5])
            for m in range(models):
                offered = [s for i, s in enumerate(storages) if (i + m) % 2 == 0 or i == 0]
                colors = [_COLORS[(n + m + i) % 5] for i in range(2)]
                out.append((category, brand, f"{_SERIES[n % 4]} {m + 2}", offered, colors, extras if m % 2 == 0 else []))
    return out


FAMILIES = made_families()
#: Title and description forms; the second titles are for goods without storage.
TITLES = ["{brand} {model}, {storage}, in {color}", "{color} {brand} {model} with {storage}", "{model} by {brand}: {storage} / {color}", "{brand} {model} [{color}] {storage}"]
PLAIN_TITLES = ["{brand} {model} in {color}", "{color} {model} by {brand}", "{brand} {model} [{color}]"]
DESCRIPTIONS = ["Key facts of the {brand} {model}: {spec}.", "{spec}: that is the {model}, made by {brand}.", "What {brand} put into this {model}: {spec}.", "Buyers of the {brand} {model} get {spec}."]
PLAIN_SPEC = "solid workmanship"
SPECS = {category: words for category, _, _, words in CATEGORIES if words}


def families(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or FAMILIES, FAMILY)


def families_of(products: DataFrame) -> DataFrame:
    """Families of a table (category, brand, model, storage, color, other_color, extra, spec) of products.

    A family's lists are the distinct values of its products in order; null ones are none. Rows
    without a category, brand or model belong to no family.
    """
    known = products.where(F.col("category").isNotNull() & F.col("brand").isNotNull() & F.col("model").isNotNull())
    values = lambda c: F.array_sort(F.collect_set(c))
    pair = F.when(F.col("color").isNotNull(), F.array("color", F.coalesce("other_color", "color")))
    return known.groupBy("category", "brand", "model").agg(
        values("storage").alias("storages"), values(pair).alias("colors"), values("extra").alias("extras"), values("spec").alias("specs")
    )


def format_storage(c: Column, spaced: Column) -> Column:
    """128GB or 128 GB; disks keep their text, null is empty. Only the number's unit moves."""
    plain = c.contains("GB") & ~c.contains("SSD")
    return F.when(c.isNull(), "").when(plain, F.regexp_replace(c, r"(\d+)\s*GB", F.when(spaced, "$1 GB").otherwise("$1GB"))).otherwise(c)


def _fill(template: Column, **parts: Column) -> Column:
    out = template
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def make_title(brand: Column, model: Column, storage: Column, color: Column, extra: Column, spaced: Column, *key) -> Column:
    """A title in one of the forms, the extra before or after it; each part is worked out once."""
    number = draw("title", *key)
    form = F.when(storage.isNotNull(), F.get(F.array(*map(F.lit, TITLES)), F.pmod(number, F.lit(len(TITLES))).cast("int"))).otherwise(
        F.get(F.array(*map(F.lit, PLAIN_TITLES)), F.pmod(number, F.lit(len(PLAIN_TITLES))).cast("int"))
    )
    t = _fill(form, brand=brand, model=model, storage=format_storage(storage, spaced), color=color)
    ahead = number % 2 == 0
    parts = F.concat_ws(" ", F.when(ahead, extra), t, F.when(~ahead, extra))
    return F.trim(F.regexp_replace(parts, r"\s+", " "))


def known_specs(category: Column) -> Column:
    """The built-in spec words of a category."""
    known = F.create_map(*[x for k, v in SPECS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(known, category), F.array().cast("array<string>"))


def spec_values(words: Column, *key) -> Column:
    """Up to two spec words, by md5."""
    keyed = F.transform(words, lambda w: F.struct(F.md5(F.concat_ws("|", w, *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])).alias("o"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, 2), lambda x: x["w"])


def format_specs(values: Column, storage: Column, extra: Column, spaced: Column, separator: Column | None = None) -> Column:
    """Spec words, storage and extra in one line: commas in one style, bars in the other."""
    parts = F.concat(values, F.array(F.nullif(format_storage(storage, spaced), F.lit("")), F.nullif(extra, F.lit(""))))
    ordered = F.array_sort(F.transform(F.array_compact(parts), lambda w: F.struct(F.md5(w).alias("o"), w.alias("w"))))
    words = F.transform(ordered, lambda x: x["w"])
    return F.when(F.size(words) == 0, "") .when(spaced if separator is None else separator, F.array_join(words, ", ")).otherwise(F.array_join(words, " | "))


def make_description(brand: Column, model: Column, values: Column, storage: Column, extra: Column, spaced: Column, *key) -> Column:
    spec = format_specs(values, storage, extra, spaced, F.lit(True))
    form = pick(F.array(*map(F.lit, DESCRIPTIONS)), "description", *key)
    return _fill(form, brand=brand, model=model, spec=F.when(spec == "", PLAIN_SPEC).otherwise(spec))


def _drawn(base: DataFrame, n: int, kind: str) -> DataFrame:
    """n rows, each with two families a and b for its kind of pair and drawn parts.

    positive: one product told twice; hard: one family, another storage or colour; easy:
    families of two categories. Families are numbered, and a draw picks a number: rows meet them by it.
    """
    base = base if "specs" in base.columns else base.withColumn("specs", known_specs(F.col("category")))
    placed = numbered(base, 42, "category", "brand", "model").withColumnRenamed("position", "_n")
    count = base.count()
    rows = base.sparkSession.range(n * 3).select(F.concat(F.lit(f"{kind}-"), "id").alias("k"))
    rows = rows.withColumn("_i", F.pmod(draw("a", "k"), F.lit(count))).withColumn("_j", F.pmod(draw("b", "k"), F.lit(count)))
    side = lambda name: placed.select(F.col("_n").alias(f"_{name}"), F.struct("category", "brand", "model", "storages", "colors", "extras", "specs").alias(name))
    rows = rows.join(side("a"), F.col("_i") == F.col("_a")).join(side("b"), (F.col("_j") if kind == "easy" else F.col("_i")) == F.col("_b"))
    if kind == "easy":
        rows = rows.where(F.col("a.category") != F.col("b.category"))
    part = lambda s, what, seed: F.when(F.size(F.col(s)[what]) > 0, pick(F.col(s)[what], seed, "k"))
    names = F.when(F.size("a.colors") > 0, pick(F.col("a.colors"), "color-a", "k"))
    other = F.when(F.size("b.colors") > 0, pick(F.col("b.colors"), "color-a" if kind == "positive" else "color-b", "k"))
    rows = rows.withColumn("storage_a", part("a", "storages", "storage-a")).withColumn("storage_b", part("b", "storages", "storage-a" if kind == "positive" else "storage-b"))
    rows = rows.withColumn("color_a", F.get(names, F.lit(0))).withColumn("color_b", F.get(other, F.lit(1 if kind == "positive" else 0)))
    rows = rows.withColumn("extra_a", part("a", "extras", "extra-a")).withColumn("extra_b", part("b", "extras", "extra-a" if kind != "easy" else "extra-b"))
    if kind == "hard":
        # what is labelled different must differ
        rows = rows.where(~F.col("storage_a").eqNullSafe(F.col("storage_b")) | ~F.col("color_a").eqNullSafe(F.col("color_b")))
    return rows.withColumn("label", F.lit(1 if kind == "positive" else 0)).withColumn("spaced", F.lit(kind == "positive"))


def _said(rows: DataFrame, layout: str) -> DataFrame:
    """Titles, and brands, descriptions or specs as the layout asks."""
    out = {}
    for k, s in ((1, "a"), (2, "b")):
        spaced = F.col("spaced") if s == "b" else F.lit(False)
        brand, model, storage, extra = F.col(f"{s}.brand"), F.col(f"{s}.model"), F.col(f"storage_{s}"), F.col(f"extra_{s}")
        # what is used more than once gets a column of its own
        rows = rows.withColumn(f"_seed_{s}", F.concat("k", F.lit(f"-{s}")))
        seed = F.col(f"_seed_{s}")
        rows = rows.withColumn(f"_specs_{s}", spec_values(F.col(f"{s}.specs"), F.when(F.col("label") == 1, F.col("k")).otherwise(seed)))
        specs = F.col(f"_specs_{s}")
        out[f"product{k}_title"] = make_title(brand, model, storage, F.col(f"color_{s}"), extra, spaced, seed)
        if layout == "structured":
            out[f"product{k}_id"] = F.concat(F.lit("P"), F.upper(F.substring(F.md5(seed), 1, 12)))
            out[f"product{k}_brand"] = brand
            out[f"product{k}_description"] = make_description(brand, model, specs, storage, extra, spaced, seed)
        elif layout == "with_specs":
            out[f"product{k}_specs"] = format_specs(specs, storage, extra, spaced)
    return rows.select("k", *[c.alias(n) for n, c in out.items()], "label")


def generate(base: DataFrame, total: int, layout: str = "title_only", seed: int = 42) -> DataFrame:
    """About total pairs, 40 / 35 / 25 positive, hard and easy; unordered repeats and equal titles go.

    layout: title_only (product1, product2), structured or with_specs.
    """
    parts = []
    for kind, n in zip(("positive", "hard", "easy"), mix_sizes(total), strict=True):
        made = unordered_first(_said(_drawn(base, n, kind), layout), "product1_title", "product2_title", ["k"], trim=False)
        parts.append(sample(made, n, seed, "k"))
    both = unordered_first(stack(parts), "product1_title", "product2_title", [F.col("label") * -1, "k"], trim=False).drop("k")
    if layout == "title_only":
        return both.select(F.col("product1_title").alias("product1"), F.col("product2_title").alias("product2"), "label")
    order = ["id", "title", "brand", "description"] if layout == "structured" else ["title", "specs"]
    return both.select(*[f"product{k}_{f}" for k in (1, 2) for f in order], "label")


def near_misses(base: DataFrame, repeats: int = 1) -> DataFrame:
    """Pairs that differ in the model, the storage, the colour or the extra alone, and for each a
    positive companion; label 0 and 1, kind tells which."""
    w = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    models = base.select("category", "brand", F.col("model").alias("v"), F.get("storages", F.lit(0)).alias("s"), F.get(F.get("colors", F.lit(0)), F.lit(0)).alias("c"), F.get("extras", F.lit(0)).alias("e"))
    by = lambda name, values: base.select("category", "brand", "model", F.explode(values).alias("v"), F.get("storages", F.lit(0)).alias("s"), F.get(F.get("colors", F.lit(0)), F.lit(0)).alias("c"), F.get("extras", F.lit(0)).alias("e")).where(F.col("v").isNotNull())
    groups = {
        "model": (models.withColumn("model", F.col("v")), ["category", "brand"]),
        "storage": (by("storage", F.array_distinct("storages")), ["category", "brand", "model"]),
        "color": (by("color", F.array_distinct(F.transform("colors", lambda c: F.get(c, F.lit(0))))), ["category", "brand", "model"]),
        "extra": (by("extra", F.array_distinct("extras")), ["category", "brand", "model"]),
    }
    out = []
    for kind, (rows, keys) in groups.items():
        pairs = triangular(rows.distinct(), "v", keys).withColumn("r", w)
        k = F.concat_ws("|", F.lit(kind), "a.brand", "a.model", "a.v", "b.v", F.col("r").cast("string"))

        def title(s: str, other: str, spaced: bool, kind=kind, k=k) -> Column:
            x = F.col(s)
            values = {"storage": x["s"], "color": x["c"], "extra": x["e"], "model": x["model"]} | {kind: F.col(other)["v"]}
            form = draw("form", k)
            return make_title(x["brand"], values["model"], values["storage"], F.coalesce(values["color"], F.lit("")), values["extra"], F.lit(spaced), form)

        row = lambda b, label: pairs.select(k.alias("k"), F.lit(kind).alias("kind"), title("a", "a", False).alias("product1"), b.alias("product2"), F.lit(label).alias("label"))
        positive = F.concat_ws(" ", title("a", "a", True), F.lit("-"), F.col("a.brand"))
        out += [row(title("b", "b", False), 0), row(positive, 1)]
    return unordered_first(stack(out), "product1", "product2", [F.col("label") * -1, "k"], trim=False).select("product1", "product2", "label", "kind")


def missing_brand_pairs(products: DataFrame, variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """products (id, title, brand, description), variants (base_id, title, and the base's description
    where they have none): a positive for each variant with its base, a negative for each pair of
    products, or with `by` for each pair of products with equal ones of these columns."""
    sides = lambda a, b: [*[F.col(f"a.{f}").alias(f"product1_{f}") for f in ("id", "title", "brand", "description")], *b]
    whole = F.struct("id", "title", "brand", "description")
    products = products.withColumn("id", F.col("id").cast("string"))
    base = products.select(whole.alias("a"))
    said = F.col("description") if "description" in variants.columns else F.lit(None).cast("string")
    v = variants.select("base_id", F.col("title").alias("alt"), said.alias("alt_description"))
    # variants grow with the products: they are not broadcast, however small their bytes on disk look
    positives = v.hint("merge").join(base, F.col("base_id").cast("string") == F.col("a.id")).select(
        *sides("a", [F.concat("a.id", F.lit("-alt")).alias("product2_id"), F.col("alt").alias("product2_title"), F.col("a.brand").alias("product2_brand"), F.coalesce("alt_description", "a.description").alias("product2_description")]), F.lit(1).alias("label")
    )
    negatives = triangular(products.select("id", "title", "brand", "description", *[c for c in by or [] if c not in ("id", "title", "brand", "description")]), "id", by).select(
        *sides("a", [F.col(f"b.{f}").alias(f"product2_{f}") for f in ("id", "title", "brand", "description")]), F.lit(0).alias("label")
    )
    return stack([positives, negatives])
