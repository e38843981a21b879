"""Same-product price gaps across stores, behind explicit gates, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite, positive, price_of_record, r2, r4, spread, spread_share
from ..functions.products import EXCLUDED_FLAGS, WEIGHT_CATEGORIES, canonical_grams, match_key

MAX_LAG_DAYS = 1


def lag_days(value: float | None) -> int:
    """Tolerated lag as a whole number of days, at least 0; the default for no number."""
    if value is None or value != value or abs(value) == float("inf"):
        return MAX_LAG_DAYS
    return max(0, int(value))


def key_of(records: DataFrame) -> Column:
    """The records' match key: their own column if they carry one, else made from their identity."""
    if "match_key" in records.columns:
        return F.col("match_key")
    return match_key(F.col("name"), F.col("brand"), F.col("strain_type"), F.col("category"), F.col("subcategory"))


def grams_of_option(records: DataFrame) -> Column:
    """The records' canonical weight: their own column if they carry one, else read off the option."""
    return F.col("weight_grams") if "weight_grams" in records.columns else canonical_grams(F.col("option"))


def anchor_day(records: DataFrame, today: str) -> DataFrame:
    """One row, `anchor`: the latest observation day that is not after today."""
    return records.where(F.to_date("observed_at") <= F.lit(today).cast("date")).agg(F.max(F.to_date("observed_at")).alias("anchor"))


def gated(records: DataFrame, today: str, max_lag_days: float | None = None, anchor: str | None = None) -> DataFrame:
    """Add match_key and reason: the first gate that excludes a record, null for none.

    category, flags, identity, then freshness against the anchor: the given one if it is a real day,
    else the data's own. The anchor is one row, broadcast.
    """
    own = anchor_day(records, today).select(F.coalesce(F.lit(anchor).try_cast("date"), F.col("anchor")).alias("_anchor"))
    key = key_of(records)
    day = F.to_date("observed_at")
    stale = F.col("_anchor").isNotNull() & (day.isNull() | (day < F.date_sub("_anchor", lag_days(max_lag_days))))
    return (
        records.withColumn("match_key", key)
        .crossJoin(F.broadcast(own))
        .withColumn(
            "reason",
            F.when(~F.col("category").isin(WEIGHT_CATEGORIES), "non-comparable-category")
            .when(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in EXCLUDED_FLAGS])), "excluded-flag")
            .when(F.col("match_key").isNull(), "unmatched")
            .when(stale, "stale"),
        )
        .drop("_anchor")
    )


def offers(gated_records: DataFrame) -> DataFrame:
    """Buyable offers of the records that passed: known weight, not sold out, a real price."""
    priced = gated_records.where("reason is null").select(
        "match_key",
        "dispensary_id",
        "product_id",
        "name",
        "category",
        grams_of_option(gated_records).alias("weight_grams"),
        price_of_record(F.col("special_price"), F.col("base_price")).alias("price"),
        "quantity_available",
    )
    in_stock = F.col("quantity_available").isNull() | (F.col("quantity_available") > 0)
    return priced.where(F.col("weight_grams").isNotNull() & in_stock & positive(F.col("price")))


def store_offers(found: DataFrame) -> DataFrame:
    """The cheapest offer of each store in each cell of product and weight; ties by product id.

    Offers are dealt by cell at once, which serves the grouping by store and that by cell after it.
    """
    found = found.repartition("match_key", "weight_grams")
    best = F.min(F.struct("price", "product_id", "name", "category", "quantity_available"))
    return found.groupBy("match_key", "weight_grams", "dispensary_id").agg(best.alias("o")).select(
        "match_key", "weight_grams", "dispensary_id", "o.price", "o.name", "o.category", "o.quantity_available"
    )


def disparities(best: DataFrame) -> DataFrame:
    """Cells with at least two stores, with their gap and their stores from cheap to dear.

    best: one row per cell and store, so the grouped list holds at most one entry a store.
    """
    cheapest = F.min(F.struct("price", "dispensary_id", "name", "category"))
    stores = F.sort_array(F.collect_list(F.struct("price", "dispensary_id", "quantity_available")))
    cells = best.groupBy("match_key", "weight_grams").agg(
        cheapest.alias("c"), F.max("price").alias("high_price"), F.count("*").alias("stores"), stores.alias("stores_carrying")
    )
    low = F.col("c.price")
    return cells.where("stores >= 2").select(
        "match_key",
        F.col("c.name").alias("display_name"),
        F.col("c.category").alias("category"),
        "weight_grams",
        low.alias("low_price"),
        "high_price",
        spread(low, F.col("high_price")).alias("spread"),
        spread_share(low, F.col("high_price")).alias("spread_pct"),
        "stores",
        "stores_carrying",
    )


def gate_counters(gated_records: DataFrame, found: DataFrame) -> DataFrame:
    """One row: records in all, by gate, and those that placed an offer."""
    by = lambda reason: F.count_if(F.col("reason") == reason)
    counts = gated_records.agg(
        F.count("*").alias("total_records"),
        by("non-comparable-category").alias("non_comparable_category_count"),
        by("excluded-flag").alias("excluded_flag_count"),
        by("unmatched").alias("unmatched_count"),
        by("stale").alias("stale_records"),
    )
    placed = found.select("dispensary_id", "product_id").distinct().agg(F.count("*").alias("placed_records"))
    return counts.crossJoin(placed)


def flat_offers(cells: DataFrame) -> DataFrame:
    return cells.select("*", F.explode("stores_carrying").alias("s")).select(
        *[c for c in cells.columns if c != "stores_carrying"], F.col("s.dispensary_id").alias("dispensary_id"), F.col("s.price").alias("price")
    )


def rollup_by_category(cells: DataFrame) -> DataFrame:
    """Count, mean relative gap and stores involved by category. cells are read twice: stage them."""
    flat = flat_offers(cells)
    stores = flat.groupBy("category").agg(F.countDistinct("dispensary_id").alias("distinct_stores"))
    sums = cells.groupBy("category").agg(F.count("*").alias("disparity_count"), r2(F.avg("spread_pct")).alias("avg_spread_pct"))
    return sums.join(stores, "category")


def rollup_by_store(cells: DataFrame, geo: DataFrame) -> DataFrame:
    """By store: cells carried, how often cheapest and dearest where there is a gap, and its place."""
    gap = F.col("high_price") > F.col("low_price")
    sums = flat_offers(cells).groupBy("dispensary_id").agg(
        F.count("*").alias("disparity_count"),
        F.count_if(gap & (F.col("price") == F.col("low_price"))).alias("times_cheapest"),
        F.count_if(gap & (F.col("price") == F.col("high_price"))).alias("times_priciest"),
    )
    return sums.join(geo.select("dispensary_id", "lat", "lng"), "dispensary_id", "left")


def endpoints(cells: DataFrame) -> DataFrame:
    """First cheapest and first dearest store of each cell; null on a tie of low and high."""
    gap = F.col("high_price") > F.col("low_price")
    high = F.array_min(F.transform(F.filter("stores_carrying", lambda s: s["price"] == F.col("high_price")), lambda s: s["dispensary_id"]))
    return cells.select(
        "match_key",
        "weight_grams",
        F.when(gap, F.col("stores_carrying")[0]["dispensary_id"]).alias("low_store"),
        F.when(gap, high).alias("high_store"),
    )


def top_gaps(cells: DataFrame, n: int = 15) -> DataFrame:
    """The n cells of the widest gap in dollars, real gaps only."""
    return cells.where("high_price > low_price").orderBy(F.desc("spread"), "match_key", "weight_grams").limit(n)


def renderable(cells: DataFrame) -> DataFrame:
    """Cells whose numbers and stores are all well formed."""
    numbers = ["low_price", "high_price", "spread", "spread_pct", "weight_grams"]
    ok = F.forall("stores_carrying", lambda s: s["dispensary_id"].isNotNull() & finite(s["price"]))
    for name in numbers:
        ok = ok & finite(F.col(name))
    return cells.where(ok & F.col("match_key").isNotNull())


def delivered_offers(cells: DataFrame, geo: DataFrame) -> DataFrame:
    """Every offer of every cell with price per gram and place; no winner is chosen here."""
    per_gram = r4(F.col("price") / F.col("weight_grams"))
    flat = flat_offers(cells).select("match_key", "display_name", "category", "weight_grams", "dispensary_id", "price", per_gram.alias("price_per_gram"))
    return flat.join(geo.select("dispensary_id", "lat", "lng"), "dispensary_id", "left")
