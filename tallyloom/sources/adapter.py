"""Domain tables over the star-schema test tables.

store: supplier; product and observation: lineitem with part; daily series and citation log: events;
deals: text made from lineitem and part. Everything is a projection, so pruning and pushdown reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import r2
from ..functions.products import canonical_grams, match_key

CATEGORY_OF = {
    "ECONOMY": "Flower",
    "SMALL": "Flower",
    "STANDARD": "Vaporizers",
    "PROMO": "Pre-Rolls",
    "LARGE": "Concentrate",
    "MEDIUM": "Edible",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("s"), key.cast("string")).alias("dispensary_id"),
        F.col("s_name").alias("name"),
        (F.lit(45.7) + (nation % 5) * F.lit(0.7) + (key % 7) * F.lit(0.01)).alias("lat"),
        (F.lit(-124.5) + F.floor(nation / 5) * F.lit(1.5) + (key % 11) * F.lit(0.01)).alias("lng"),
        F.concat(key.cast("string"), F.lit(" Main St, City "), nation.cast("string"), F.lit(", WA 98"), F.lpad(nation.cast("string"), 3, "0")).alias("address"),
        F.col("s_acctbal").alias("balance"),
    )


def _category(column: str):
    out = F.lit("Other")
    for kind, category in CATEGORY_OF.items():
        out = F.when(F.col(column) == kind, category).otherwise(out)
    return out


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: identity columns of a product, with flags, match key and canonical weight.

    Keys and weights depend on identity alone, so they are made here, before any join with observations. They take much
    work a row and the files are small, so rows are dealt out first: a number that is given is kept, whatever their bytes.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition(parts, "p_partkey")
    key = F.col("p_partkey")
    none = F.array().cast("array<string>")
    named = p.select(
        key.alias("partkey"),
        F.concat(F.lit("p"), key.cast("string")).alias("product_id"),
        F.col("p_name").alias("name"),
        _category("p_type").alias("category"),
        F.when(key % 17 != 0, F.col("p_brand")).alias("brand"),
        F.lit(None).cast("string").alias("strain_type"),
        F.when((F.col("p_type") == "LARGE") & (F.col("p_size") % 3 == 0), "Live Resin").alias("subcategory"),
        F.concat(F.col("p_size").cast("string"), F.lit("g")).alias("option"),
        F.when(key % 11 == 0, F.array(F.lit("weight-mismatch"))).when(key % 13 == 0, F.array(F.lit("assumed-single"))).otherwise(none).alias("flags"),
    )
    identity = match_key(F.col("name"), F.col("brand"), F.col("strain_type"), F.col("category"), F.col("subcategory"))
    return named.withColumns({"match_key": identity, "weight_grams": canonical_grams(F.col("option"))})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: an observation of a product at a store with its one option's prices and stock."""
    li = _table(spark, sf_dir, "lineitem")
    base = r2(F.col("l_extendedprice") / F.col("l_quantity"))
    special = F.col("l_discount") >= 0.05
    return li.select(
        F.col("l_partkey").alias("partkey"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dispensary_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_seq"),
        F.col("l_shipdate").alias("observed_at"),
        special.alias("special"),
        base.alias("base_price"),
        F.when(special, r2(base * (1 - F.col("l_discount")))).alias("special_price"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("quantity_available"),
    )


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (store, product): identity and its latest observation by insertion order.

    The latest row is a partial aggregate, so a product's history is never gathered; identity joins after. Each
    column is picked by itself: buffers of fixed width allow a hash aggregate, where a struct would need a sort.
    """
    fields = ["observed_at", "base_price", "quantity_available", "special", "special_price"]
    latest = observations(spark, sf_dir).groupBy("dispensary_id", "partkey").agg(*[F.max_by(c, "obs_seq").alias(c) for c in fields])
    return latest.join(catalog(spark, sf_dir), "partkey").drop("partkey")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a daily-series observation of a product at a store."""
    e = _table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("dispensary_id"),
        F.concat(user, F.lit("-"), F.col("event_type")).alias("product_id"),
        F.concat(F.lit("Brand "), (F.col("user_id") % 9).cast("string")).alias("brand"),
        F.col("event_id").alias("obs_seq"),
        F.col("ts").alias("observed_at"),
        F.to_date("ts").alias("day"),
        (F.col("value") > 20).alias("special"),
        F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("price"),
    )


PHRASES = [
    "eighth of flower",
    "pre-rolls 2 pack",
    "vape carts",
    "your cart storewide",
    "live resin and shatter",
    "edibles and drinks",
    "select brands",
    "entire store",
    "ounces over $100",
    "something nice",
]
WINDOWS = [(None, None), ("09:00", "11:30"), ("16:00", "18:00"), ("22:00", "02:00"), ("08:00", "08:00"), ("25:00", "10:00")]


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deal per line item: text, days, window, kind and percentage."""
    li = _table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("l_partkey") % len(PHRASES)).cast("int"))
    pct = (F.floor(F.col("l_discount") * 100 + 0.5)).cast("int")
    w = (F.col("l_suppkey") % len(WINDOWS)).cast("int")
    days = ["monday", "tuesday", "friday", "saturday", "sunday", "everyday", "someday"]
    kth = lambda values, k: F.get(F.array(*[F.lit(v).cast("string") for v in values]), k)
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("deal_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dispensary_id"),
        F.when(n % 4 == 0, "happy_hour").otherwise("daily").alias("type"),
        F.concat(pct.cast("string"), F.lit("% off "), phrase).alias("description"),
        pct.alias("discount_pct"),
        kth([a for a, _ in WINDOWS], w).alias("start_time"),
        kth([b for _, b in WINDOWS], w).alias("end_time"),
        F.array(kth(days, (n % 7).cast("int"))).alias("days_valid"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation log: engine, question, whether the own site was cited, and the domains seen."""
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("check_id"),
        F.col("event_type").alias("engine"),
        F.concat(F.lit("q"), (F.col("user_id") % 8).cast("string")).alias("question"),
        F.col("ts").alias("checked_at"),
        (F.col("value") > 20).alias("cited"),
        (F.col("event_type") == "error").alias("errored"),
        F.array(F.concat(F.lit("site"), (k % 17).cast("string"), F.lit(".example")), F.concat(F.lit("site"), (k % 5).cast("string"), F.lit(".example"))).alias("domains"),
    )
