"""Deals: validity, activity, what they cover, and the deal feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.deals import deal_active, deal_categories, deal_scope, tier_key, usable_days, usable_window
from ..functions.numbers import positive, price_of_record
from ..functions.products import EXCLUDED_FLAGS
from ..functions.text import clean_description
from ..plans.staging import staged
from .disparity import grams_of_option
from .ranking import ranked as ordered

#: Categories that a deal can cover. Edibles and concentrates are in no deal, the whole store's included.
LINKABLE = ["Flower", "Vaporizers", "Pre-Rolls"]
LINKED_KINDS = ["storewide", "category"]


def by_text(deals: DataFrame, **made: Column) -> DataFrame:
    """deals with the columns `made` of their description, each distinct description judged once: deals repeat few of them.

    Rows find what was made by equality, nulls too; AQE broadcasts it where it is small and splits descriptions that many
    rows share. Distinct ones are dealt out by number, as judging costs more than their bytes tell.
    """
    spark = deals.sparkSession
    texts = deals.select("description").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "description")
    judged = staged(texts.select(F.col("description").alias("_text"), *[c.alias(f"_made_{n}") for n, c in made.items()]), "judged")
    found = deals.join(judged, F.col("description").eqNullSafe(F.col("_text")))
    return found.select(*[c for c in deals.columns if c not in made], *[F.col(f"_made_{n}").alias(n) for n in made])


def usable_deals(deals: DataFrame) -> DataFrame:
    """Deals with a usable window and usable days, their descriptions cleaned."""
    ok = usable_window(F.col("start_time"), F.col("end_time")) & usable_days(F.col("days_valid"))
    return by_text(deals.where(ok), description=clean_description(F.col("description"))).select(deals.columns)


def active_deals(deals: DataFrame, day: str, minute: int) -> DataFrame:
    return deals.where(deal_active(F.col("days_valid"), F.col("start_time"), F.col("end_time"), day, minute))


def scoped_deals(deals: DataFrame) -> DataFrame:
    """deal_id, dispensary_id, kind, category, weight_grams, targeted (the word that put a deal out of the catalog)."""
    scoped = by_text(deals.select("deal_id", "dispensary_id", "description"), scope=deal_scope(F.col("description")))
    return scoped.select("deal_id", "dispensary_id", "scope.*")


def _goods(records: DataFrame) -> DataFrame:
    """Priced products of the linkable categories, with what decides whether a scope covers them."""
    priced = positive(price_of_record(F.col("special_price"), F.col("base_price")))
    return records.where(priced & F.col("category").isin(LINKABLE)).select(
        F.col("dispensary_id").alias("store"),
        "product_id",
        F.col("category").alias("product_category"),
        grams_of_option(records).alias("grams"),
        F.coalesce(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in EXCLUDED_FLAGS])), F.lit(False)).alias("unsound"),
    )


def _covers() -> Column:
    weighed = F.col("weight_grams").isNull() | (~F.col("unsound") & (F.col("grams") == F.col("weight_grams")))
    return (F.col("kind") == "storewide") | ((F.col("kind") == "category") & (F.col("category") == F.col("product_category")) & weighed)


def scope_products(deals: DataFrame, records: DataFrame) -> DataFrame:
    """The products that each scope of a store covers: dispensary_id, kind, category, weight_grams, product_id.

    Deals of a store that say the same share a scope, so this is the table of links without its repetitions:
    scoped_deals joins to it on the first four columns. Flagged products are covered but where a weight is asked.
    """
    scopes = scoped_deals(deals).where(F.col("kind").isin(LINKED_KINDS)).select("dispensary_id", "kind", "category", "weight_grams").distinct()
    goods = _goods(records)
    met = scopes.join(goods, (scopes["dispensary_id"] == goods["store"]) & _covers())
    return met.select("dispensary_id", "kind", "category", "weight_grams", "product_id")


def deal_links(deals: DataFrame, records: DataFrame) -> DataFrame:
    """How many products each deal covers, with the deal's scope: deal_id, kind, linked.

    Deals of a store share few scopes and its products few kinds, so covered products are counted by scope first; a
    deal then finds its scope's count by equality, and no deal is compared with products. A deal listed twice counts twice.

    A whole-store deal covers all priced products of the linkable categories, a category deal its category, a
    weighed one only sound products priced at that weight. Links say what is covered and never what is saved.
    """
    scope = ["dispensary_id", "kind", "category", "weight_grams"]
    repeated = scoped_deals(deals).groupBy("deal_id", *scope).agg(F.count("*").alias("_times"))
    scoped = staged(repeated, "scoped")  # read twice, and costly to make
    goods = _goods(records).groupBy("store", "product_category", "grams", "unsound").agg(F.count("*").alias("_n"))
    scopes = scoped.where(F.col("kind").isin(LINKED_KINDS)).select(*scope).distinct()
    counts = scopes.join(goods, (scopes["dispensary_id"] == goods["store"]) & _covers()).groupBy(*scope).agg(F.sum("_n").alias("_linked"))
    counts = counts.withColumnsRenamed({c: f"_of_{c}" for c in scope})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in scope])
    return scoped.join(counts, same, "left").select("deal_id", *scope, (F.col("_times") * F.coalesce("_linked", F.lit(0))).alias("linked"))


def link_counters(links: DataFrame) -> DataFrame:
    by = lambda kind: F.count_if(F.col("kind") == kind)
    linkable = F.col("kind").isin(LINKED_KINDS)
    return links.agg(
        F.count("*").alias("total_deals"),
        by("storewide").alias("storewide_count"),
        by("category").alias("category_count"),
        by("brand").alias("brand_count"),
        by("unsupported-category").alias("unsupported_count"),
        by("unresolved").alias("unresolved_count"),
        F.count_if(linkable & (F.col("linked") == 0)).alias("zero_match_count"),
        F.coalesce(F.sum("linked"), F.lit(0)).alias("linked_products"),
    )


def selected_deals(deals: DataFrame, selected: str | None) -> DataFrame:
    """The deals that show under a category; all of them where none is selected."""
    if selected is None:
        return deals
    return by_text(deals, _in=in_selection(F.col("description"), selected)).where("_in").drop("_in")


def in_selection(description: Column, selected: str | None) -> Column:
    """Whether a deal shows under a category; whole-store deals show under every product category."""
    if selected is None:
        return F.lit(True)
    found = deal_categories(description)
    wild = F.lit(selected not in ("store-wide", "online-order", "price-drop", "special-pricing"))
    return F.array_contains(found, selected) | (wild & F.array_contains(found, "store-wide"))


def feed(deals: DataFrame, places: DataFrame, minute: int, selected: str | None = None, radius: float | None = None) -> DataFrame:
    """The deal feed: deals ranked, grouped by store, stores by distance with unknown last, then by best deal, then by id.

    Adds store_rank and deal_rank. places: dispensary_id, distance_miles; an unknown distance is never
    filtered, deals of stores that places do not list are in no feed. Ranking is within a store; the order of
    stores is global, over one row per store, by ranges. The id comes last as best deals of stores can share a deal_id.
    """
    tier, value = tier_key(F.col("type"), F.col("start_time"), F.col("end_time"), F.col("discount_pct"), minute)
    chosen = selected_deals(deals, selected).withColumn("tier", tier).withColumn("value", value)
    if radius is not None:
        near = places.where(F.col("distance_miles").isNull() | (F.col("distance_miles") <= radius))
        chosen = chosen.join(near.select("dispensary_id"), "dispensary_id", "left_semi")
    own = Window.partitionBy("dispensary_id").orderBy("tier", "value", "deal_id")
    ranked = chosen.withColumn("deal_rank", F.row_number().over(own))
    heads = ranked.where("deal_rank = 1").join(places.select("dispensary_id", "distance_miles"), "dispensary_id")
    heads = heads.select("dispensary_id", "distance_miles", "tier", "value", "deal_id")
    stores = ordered(heads, F.col("distance_miles").asc_nulls_last(), "tier", "value", "deal_id", "dispensary_id", name="store_rank")
    return ranked.join(stores.select("dispensary_id", "distance_miles", "store_rank"), "dispensary_id")


def deal_blocks(deals: DataFrame) -> DataFrame:
    """Deals of a store with one kind and title taken together; percentages as one figure or a range."""
    grouped = deals.groupBy("dispensary_id", "type", "title").agg(
        F.min("deal_id").alias("first_deal"), F.count("*").alias("deals"), F.min("discount_pct").alias("low"), F.max("discount_pct").alias("high")
    )
    one = F.concat(F.col("low").cast("string"), F.lit("%"))
    both = F.concat(F.col("low").cast("string"), F.lit("–"), F.col("high").cast("string"), F.lit("%"))
    return grouped.withColumn("pct_label", F.when(F.col("high") <= 0, None).when(F.col("low") == F.col("high"), one).otherwise(both))
