"""Attributes and categories read from listing text, and one-attribute rewordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, first_group, text

#: Colours in the order in which they are tried, as parts of any word.
COLORS = ["black", "white", "silver", "gold", "blue", "red", "green", "grey", "gray", "titanium", "rose gold", "purple", "yellow", "pink", "bronze"]
#: Category keywords in the order in which they are tried, as parts of any word.
CATEGORIES = {
    "LAPTOP": ["laptop", "notebook", "macbook", "ultrabook"],
    "SMARTPHONE": ["smartphone", "iphone", "galaxy s", "pixel phone"],
    "TWS_EARBUDS": ["earbuds", "airdopes", "tws", "buds"],
    "CAMERA": ["camera", "dslr", "mirrorless", "lens"],
    "FOOTWEAR": ["shoe", "sneaker", "boot", "sandal"],
    "SOFTWARE": ["software", "license", "cd-rom", "diskette"],
    "NETWORKING": ["router", "modem", "switch", "access point"],
}
OTHER = "OTHER"
#: Patterns of memory, storage and radio versions.
RAM = r"(?iU)\b(\d{1,3})\s*gb\s*ram\b"
STORAGE = r"(?iU)\b(\d{1,4})\s*(gb|tb)\b(?!\s*ram)"
BLUETOOTH = r"(?iU)\bbluetooth\s*v?(\d\.\d)\b"
#: What a swapped attribute may become.
SWAP_COLORS = ["black", "white", "silver", "blue", "red", "grey", "gold"]
SWAP_RAM = ["4", "8", "16", "32"]
SWAP_STORAGE = ["128gb", "256gb", "512gb", "1tb"]

ATTRIBUTES = ["color", "ram", "storage", "bluetooth_version"]


def _first_of(cases: list[tuple[Column, object]], default=None) -> Column:
    out = F.lit(default)
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def extract_attributes(c: str | Column) -> Column:
    """struct<color, ram, storage, bluetooth_version>; null where none is found."""
    low = F.lower(text(c))
    return F.struct(
        _first_of([(low.contains(w), F.lit(w)) for w in COLORS]).cast("string").alias("color"),
        first_group(low, RAM).alias("ram"),
        F.when(low.rlike(STORAGE), F.concat(F.regexp_extract(low, STORAGE, 1), F.regexp_extract(low, STORAGE, 2))).alias("storage"),
        first_group(low, BLUETOOTH).alias("bluetooth_version"),
    )


def categorize(c: str | Column) -> Column:
    low = F.lower(text(c))
    cases = []
    for name, words in CATEGORIES.items():
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        cases.append((hit, F.lit(name)))
    return _first_of(cases, OTHER)


def attributes_differ(a: Column, b: Column) -> Column:
    """Whether some attribute is known on both sides and not the same."""
    out = F.lit(False)
    for name in ATTRIBUTES:
        out = out | F.coalesce(a[name] != b[name], F.lit(False))
    return out


def swap_attribute(title: str | Column, description: str | Column, draw: Column) -> Column:
    """struct<title, description, attribute>: the first swappable attribute replaced, else null.

    Colours are tried first, then memory, then storage, each as a part of any word. `draw`
    (a whole number) picks among the other values.
    """
    t, d = text(title), text(description)
    both = F.lower(F.concat(t, F.lit(" "), d))
    found, plans = [], []
    for name, values, suffix in (("color", SWAP_COLORS, ""), ("ram", SWAP_RAM, "gb ram"), ("storage", SWAP_STORAGE, "")):
        for v in values:
            others = F.array(*[F.lit(o + suffix) for o in values if o != v])
            chosen = F.element_at(others, (F.pmod(draw, F.lit(len(values) - 1)) + 1).cast("int"))
            plans.append((both.contains(v + suffix), F.struct(F.lit(name).alias("attribute"), F.lit(v + suffix).alias("old"), chosen.alias("new"))))
    found = F.when(plans[0][0], plans[0][1])
    for test, plan in plans[1:]:
        found = found.when(test, plan)
    swap = lambda c: F.replace(F.lower(c), found["old"], found["new"])
    return F.when(found.isNotNull(), F.struct(swap(t).alias("title"), F.when(col(description).isNotNull(), swap(d)).alias("description"), found["attribute"].alias("attribute")))
