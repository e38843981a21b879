"""Normalizing raw products, and merges into the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import approx_equal, per_gram, per_item
from ..functions.products import PRE_ROLLS, WEIGHT_CATEGORIES, grams_of, pack_count


def normalize_products(raw: DataFrame) -> DataFrame:
    """raw: name, category, weight_field, net_weight_mg, options. Adds pack_count, flags and priced options.

    Unit prices need a weight, which only weighed categories have; prices per item only pre-rolls. A
    pre-roll without a count is a single, flagged so. The stated weights of a product with one option must
    agree within two percent; a pack with several options cannot be checked and is flagged.
    """
    weighed = F.col("category").isin(WEIGHT_CATEGORIES)
    rolled = F.col("category") == PRE_ROLLS
    parsed = pack_count(F.col("name"))
    base = raw.withColumn("_parsed", parsed).withColumn("pack_count", F.when(rolled, F.coalesce("_parsed", F.lit(1))).otherwise(F.col("_parsed")))

    def priced(o: Column) -> Column:
        grams = F.when(weighed, grams_of(o["option"]))
        pack = F.when(rolled, F.col("pack_count"))
        return F.struct(
            o["option"].alias("option"),
            grams.alias("weight_grams"),
            o["base_price"].alias("base_price"),
            o["special_price"].alias("special_price"),
            per_gram(o["base_price"], grams).alias("price_per_gram"),
            per_item(o["base_price"], pack).alias("price_per_item"),
            per_gram(o["special_price"], grams).alias("special_price_per_gram"),
            per_item(o["special_price"], pack).alias("special_price_per_item"),
            o["quantity_available"].alias("quantity_available"),
        )

    out = base.withColumn("options", F.transform("options", priced))
    only = F.get("options", F.lit(0))["weight_grams"] * 1000
    known = (F.size("options") == 1) & only.isNotNull() & F.col("net_weight_mg").isNotNull() & F.col("weight_field").isNotNull() & F.col("pack_count").isNotNull()
    apart = ~approx_equal(F.col("net_weight_mg"), only) | ~approx_equal(F.col("weight_field") * F.col("pack_count"), only)
    flags = [
        F.when(rolled & F.col("_parsed").isNull(), "assumed-single"),
        F.when(weighed & F.exists("options", lambda o: o["weight_grams"].isNull()), "unparseable-weight"),
        F.when(known & apart, "weight-mismatch"),
        F.when(weighed & (F.size("options") > 1) & (F.col("pack_count") > 1), "unreconciled-pack"),
    ]
    return out.withColumn("flags", F.filter(F.array(*flags), lambda f: f.isNotNull())).drop("_parsed")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order."""
    axis = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(axis)).where("_n = 1").drop("_n")


def new_observations(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key: what an idempotent append writes."""
    return first_wins(incoming.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, ["obs_seq"])


def refreshed_identity(products: DataFrame, appended: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Products with the identity of their last appended observation; a duplicate that was not appended refreshes nothing."""
    latest = appended.groupBy(*keys).agg(F.max_by(F.struct(*fields), "obs_seq").alias("_new"))
    joined = products.join(latest, keys, "full_outer")
    return joined.select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def ingest_outcomes(stores: DataFrame, entries: DataFrame) -> DataFrame:
    """entries: dispensary_id, deal_count, confirmed_empty. By entry: unknown, ok, empty or stale.

    A push without deals keeps the last good ones unless the store confirmed that it has none.
    """
    known = stores.select("dispensary_id", F.lit(True).alias("_known"))
    outcome = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("deal_count") > 0, "ok")
        .when(F.coalesce("confirmed_empty", F.lit(False)), "empty")
        .otherwise("stale")
    )
    return entries.join(known, "dispensary_id", "left").select(*entries.columns, outcome.alias("outcome"))


def merged_stores(stores: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Stores after a push: fetch time and staleness by outcome; stores without an entry stay as they are."""
    joined = stores.join(outcomes.select("dispensary_id", "outcome"), "dispensary_id", "left")
    good = F.col("outcome").isin("ok", "empty")
    return joined.withColumn("last_fetched_at", F.when(good, F.lit(now)).otherwise(F.col("last_fetched_at"))).withColumn(
        "stale", F.when(good, False).when(F.col("outcome") == "stale", True).otherwise(F.col("stale"))
    ).drop("outcome")


def confirmed_empty(attempts: DataFrame) -> DataFrame:
    """attempts: dispensary_id, ok, captured, cards. Empty is confirmed only if every attempt succeeded, captured a page and found none."""
    empty = F.col("ok") & F.col("captured") & (F.col("cards") == 0)
    return attempts.groupBy("dispensary_id").agg(F.bool_and(F.coalesce(empty, F.lit(False))).alias("confirmed_empty"))


def kept_reference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Reference values: a new one replaces the old only if it is a number over zero."""
    usable = new.where((F.col(value) > 0) & (F.col(value) < float("inf"))).select(key, F.col(value).alias("_new"))
    return old.join(usable, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))


def upsert_by_date(history: DataFrame, derived: DataFrame, date: str = "date") -> DataFrame:
    """History with the rows of derived dates replaced, in date order."""
    return history.join(derived.select(date).distinct(), date, "left_anti").unionByName(derived).orderBy(date)


def histories(observations: DataFrame, products: DataFrame, keys: list[str], order: str, product: str) -> DataFrame:
    """Observations with the identity of their product and their position in its history, from 1 in `order`.

    products: one row per `product`; observations of unknown products are left out before they are sorted. A
    task sorts the histories that fall to it and holds none whole.
    """
    known = observations.join(products, product)
    return known.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
