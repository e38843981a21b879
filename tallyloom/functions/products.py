"""Package sizes, identities and match keys of products as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let, r2

# Weights, words and categories that results depend on.
GRAMS_PER_OUNCE = 28.3495
STANDARD_GRAMS = [0.35, 0.5, 0.7, 0.75, 0.8, 1, 1.2, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 7, 10, 14, 28]
SNAP_TOLERANCE = 0.02
FILLER_WORDS = [
    "flower",
    "preroll",
    "prerolls",
    "pre",
    "roll",
    "rolls",
    "vape",
    "vapes",
    "cartridge",
    "cartridges",
    "cart",
    "carts",
    "infused",
    "joint",
    "joints",
    "disposable",
    "disp",
    "pk",
    "pack",
    "packs",
    "ct",
    "count",
    "oz",
    "ounce",
    "g",
    "gram",
    "grams",
    "mg",
    "by",
]
WEIGHT_CATEGORIES = ["Flower", "Vaporizers", "Pre-Rolls", "Concentrate"]
PRE_ROLLS = "Pre-Rolls"
CONCENTRATE = "Concentrate"
EXCLUDED_FLAGS = ["weight-mismatch", "unparseable-weight", "unparseable-pack", "unreconciled-pack"]


def pack_count(name: Column) -> Column:
    """First "<n> pk / pack / joints / ct / count" of a name; null without one or for zero."""
    n = F.regexp_extract(name, r"(?i)([0-9]+)\s*-?\s*(?:pk|packs?|joints?|ct|count)(?![A-Za-z0-9_])", 1)
    return F.when(n != "", F.nullif(n.try_cast("int"), F.lit(0)))


def grams_of(label: Column) -> Column:
    """Grams that a size label states: fractions first, then a number with its unit, grams if bare."""
    fraction = r"(?i)([0-9]+)\s*/\s*([0-9]+)\s*(g|gram|grams|mg|milligram|milligrams|oz|ounce|ounces)?"
    plain = r"(?i)([0-9.]+)\s*(g|gram|grams|mg|milligram|milligrams|oz|ounce|ounces)?"
    part = lambda pattern, k: F.regexp_extract(label, pattern, k)
    top, bottom, unit = part(fraction, 1).try_cast("double"), part(fraction, 2).try_cast("double"), F.lower(part(fraction, 3))
    ratio = F.when(bottom != 0, top / bottom)
    from_fraction = F.when(unit.startswith("m"), r2(ratio / 1000)).when(unit.startswith("o"), r2(ratio * GRAMS_PER_OUNCE)).otherwise(r2(ratio))
    number = F.regexp_extract(part(plain, 1), r"^[0-9]*\.?[0-9]+|^[0-9]+", 0).try_cast("double")
    unit = F.lower(part(plain, 2))
    from_number = F.when(unit.startswith("m"), number / 1000).when(unit.startswith("o"), r2(number * GRAMS_PER_OUNCE)).otherwise(number)
    return F.when(part(fraction, 1) != "", from_fraction).otherwise(from_number)


def canonical_grams(label: Column) -> Column:
    """Grams snapped to the nearest standard weight within two percent, else to the cent; null if none remain."""
    standards = F.array(*[F.lit(float(s)) for s in STANDARD_GRAMS])

    def snapped(grams: Column) -> Column:
        near = F.transform(standards, lambda s, i: F.struct((F.abs(grams - s) / s).alias("delta"), (-i).alias("later"), s.alias("standard")))
        close = F.filter(near, lambda c: c["delta"] <= SNAP_TOLERANCE)
        return F.when(grams > 0, F.coalesce(F.array_min(close)["standard"], F.nullif(r2(grams), F.lit(0.0))))

    return let(grams_of(label), snapped)


def plain_words(s: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and spaces to spaces, spaces collapsed; null as ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def without_measurements(name: Column) -> Column:
    """Drop fractions, numbers with units and bare decimals; bare integers stay, they may name a product."""
    edge = r"(?<![A-Za-z0-9_])"
    end = r"(?![A-Za-z0-9_])"
    weight = r"(?:g|grams?|mg|milligrams?|oz|ounces?|kg|lb)"
    s = F.lower(name)
    s = F.regexp_replace(s, rf"{edge}[0-9]+\s*/\s*[0-9]+\s*{weight}?{end}", " ")
    s = F.regexp_replace(s, rf"{edge}[0-9]+(?:\.[0-9]+)?\s*(?:{weight[3:-1]}|ml|pk|packs?|ct|count|joints?|x){end}", " ")
    return F.regexp_replace(s, rf"{edge}[0-9]+\.[0-9]+{end}", " ")


def name_words(name: Column, brand: Column) -> Column:
    """Distinctive words of a name, sorted, repeats kept, without the brand's words and filler."""
    words = F.split(plain_words(without_measurements(name)), " ")
    filler = F.array(*[F.lit(w) for w in ["", *FILLER_WORDS]])
    dropped = F.concat(F.split(plain_words(brand), " "), filler)
    kept = let(dropped, lambda d: F.filter(words, lambda w: ~F.array_contains(d, w)))
    return F.array_join(F.sort_array(kept), " ")


def match_key(name: Column, brand: Column, strain_type: Column, category: Column, subcategory: Column) -> Column:
    """Weight-free identity; null where neither brand nor name says anything. The form counts for concentrates alone."""

    def keyed(own: Column) -> Column:
        parts = F.concat_ws("|", own["brand"], own["words"], plain_words(strain_type), plain_words(category))
        key = F.when(category == CONCENTRATE, F.concat_ws("|", parts, plain_words(subcategory))).otherwise(parts)
        return F.when((own["brand"] != "") | (own["words"] != ""), key)

    return let(F.struct(plain_words(brand).alias("brand"), name_words(name, brand).alias("words")), keyed)


def brand_key(brand: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(brand), "[^a-z0-9]+", " ")), F.lit(""))
