"""What brands do: how often discounted, where carried, where cheapest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import positive, price_of_record
from ..functions.products import EXCLUDED_FLAGS, WEIGHT_CATEGORIES, brand_key
from ..plans.staging import staged
from .tally import Tally, watched

MIN_PRODUCT_DAYS = 10
HIGH_SHARE = 0.95
LOW_SHARE = 0.05


def display_brands(products: DataFrame) -> DataFrame:
    """brand_key, display_brand: the commonest spelling, the smallest on a tie, trimmed."""
    spelled = products.groupBy(brand_key(F.col("brand")).alias("brand_key"), "brand").agg(F.count("*").alias("n"))
    first = F.min_by("brand", F.struct((-F.col("n")).alias("n"), "brand"))
    return spelled.where("brand_key is not null").groupBy("brand_key").agg(F.trim(first).alias("display_brand"))


def personas(days: DataFrame, products: DataFrame, min_days: int = MIN_PRODUCT_DAYS) -> DataFrame:
    """days: one row per product and observed day with its last `special`; products: dispensary_id, product_id, brand.

    The share of product-days on special tells an always discounted brand from one never discounted;
    under `min_days` product-days nothing is claimed.
    """
    keys = ["dispensary_id", "product_id"]
    counts = days.groupBy(*keys).agg(F.count("*").alias("observed"), F.count_if("special").alias("special"))
    joined = products.select(*keys, brand_key(F.col("brand")).alias("brand_key")).where("brand_key is not null").join(counts, keys, "left")
    sums = joined.groupBy("brand_key").agg(
        F.count("*").alias("product_count"),
        F.sum(F.coalesce("observed", F.lit(0))).alias("observed_product_days"),
        F.sum(F.coalesce("special", F.lit(0))).alias("special_product_days"),
    )
    share = F.when(F.col("observed_product_days") >= min_days, F.col("special_product_days") / F.col("observed_product_days"))
    named = sums.withColumn("special_day_fraction", share).join(display_brands(products), "brand_key")
    persona = (
        F.when(F.col("special_day_fraction").isNull(), "insufficient-history")
        .when(F.col("special_day_fraction") >= HIGH_SHARE, "always-on-special")
        .when(F.col("special_day_fraction") <= LOW_SHARE, "never-discounted")
        .otherwise("intermittently-discounted")
    )
    return named.withColumn("persona", persona)


def availability(products: DataFrame) -> DataFrame:
    """products: brand, dispensary_id, product_id, weight_grams. By brand: products, stores and weights carried.

    Products are counted by store first and lists are gathered of distinct values, so no list is held for a product.
    """
    keyed = products.withColumn("brand_key", brand_key(F.col("brand"))).where("brand_key is not null")
    carried = staged(keyed.select("brand_key", "dispensary_id", "product_id", "weight_grams"), "carried")  # read twice, and costly to make
    own = F.when(F.col("dispensary_id").isNotNull(), F.col("product_id"))
    stores = carried.groupBy("brand_key", "dispensary_id").agg(F.countDistinct(own).alias("_n")).groupBy("brand_key")
    stores = stores.agg(F.sum("_n").alias("product_count"), F.sort_array(F.collect_list("dispensary_id")).alias("stores_carrying"))
    tiers = carried.select("brand_key", "weight_grams").distinct().groupBy("brand_key").agg(F.sort_array(F.collect_list("weight_grams")).alias("tiers"))
    return stores.join(tiers, "brand_key")


def store_matrix(records: DataFrame, tally: Tally | None = None) -> DataFrame:
    """By brand: its spelling, products and stores, and the weights at which it is offered.

    records: one row per store, product and option. Every product with a brand counts as available; only a buyable offer
    of a sound record in a category with weights gives a weight. Counted on the way: products without a brand, and those
    with one but without a match key, which take no part in the cells. Rows are counted by spelling and store first, and
    weights are gathered of distinct values, so no list is held for a product.
    """
    key, none = brand_key(F.col("brand")), F.array().cast("array<double>")
    own = F.when(F.col("dispensary_id").isNotNull(), F.col("product_id"))
    stores = records.groupBy("brand", "dispensary_id").agg(F.count("*").alias("_n"), F.count_if(F.col("match_key").isNull()).alias("_unmatched"), F.countDistinct(own).alias("_products"))
    sums = [F.sum(c).alias(c) for c in ("_n", "_unmatched", "_products")]
    spelled = stores.groupBy("brand").agg(*sums, F.collect_list("dispensary_id").alias("_stores")).withColumn("brand_key", key)
    unbranded = F.col("brand_key").isNull()
    spelled = watched(tally, spelled, null_brand_products=F.sum(F.when(unbranded, F.col("_n"))), unmatched_products=F.sum(F.when(~unbranded, F.col("_unmatched"))))
    named = spelled.where("brand_key is not null").groupBy("brand_key").agg(
        F.trim(F.min_by("brand", F.struct((-F.col("_n")).alias("n"), "brand"))).alias("display_brand"),
        F.sum("_products").alias("product_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_stores")))).alias("stores_carrying"),
    )
    weights = records.where(weighable(records)).select("brand", "weight_grams").distinct().select(key.alias("brand_key"), "weight_grams")
    tiers = weights.where("brand_key is not null").groupBy("brand_key").agg(F.array_sort(F.collect_set("weight_grams")).alias("_tiers"))
    found = named.join(tiers, "brand_key", "left").withColumn("tiers", F.coalesce("_tiers", none)).drop("_tiers")
    return watched(tally, found, total_brands=F.count("*"), multi_store_brands=F.count_if(F.size("stores_carrying") >= 2))


def weighable(records: DataFrame) -> Column:
    """Whether a record's option is a buyable offer with an honest weight."""
    price = price_of_record(F.col("special_price"), F.col("base_price"))
    flagged = F.coalesce(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in EXCLUDED_FLAGS])), F.lit(False))
    in_stock = F.col("quantity_available").isNull() | (F.col("quantity_available") > 0)
    return F.coalesce(F.col("category").isin(WEIGHT_CATEGORIES) & ~flagged & F.col("weight_grams").isNotNull() & in_stock & positive(price), F.lit(False))


def matrix_cells(records: DataFrame, tally: Tally | None = None) -> DataFrame:
    """The like-for-like cells of each brand that two stores or more offer, with all cheapest stores."""
    price = price_of_record(F.col("special_price"), F.col("base_price"))
    keyed = records.where(weighable(records) & F.col("match_key").isNotNull()).withColumns({"brand_key": brand_key(F.col("brand")), "price": price})
    cell = ["brand_key", "match_key", "weight_grams"]
    keyed = keyed.where("brand_key is not null").repartition(*cell)  # serves both groupings
    best = F.min(F.struct("price", "product_id", "name"))
    per_store = keyed.groupBy(*cell, "dispensary_id").agg(best.alias("o")).select(*cell, "dispensary_id", "o.price", "o.name")
    return watched(tally, cheapest_cells(per_store), cheapest_cells=F.count("*"))


def cheapest_cells(best: DataFrame) -> DataFrame:
    """best: brand_key, match_key, weight_grams, dispensary_id, price, name. Cells of two stores or more with all cheapest stores.

    One grouping: the list of a cell holds one entry a store, and its lowest are read off it.
    """
    offers = F.sort_array(F.collect_list(F.struct("price", "dispensary_id", "name")))
    cells = best.groupBy("brand_key", "match_key", "weight_grams").agg(offers.alias("_o")).where(F.size("_o") >= 2)
    low = F.col("_o")[0]
    cheapest = F.transform(F.filter("_o", lambda o: o["price"] == low["price"]), lambda o: o["dispensary_id"])
    return cells.select(
        "brand_key",
        "match_key",
        "weight_grams",
        low["price"].alias("low_price"),
        F.size("_o").cast("long").alias("stores_carrying"),
        cheapest.alias("cheapest_stores"),
        low["name"].alias("display_name"),
    )
