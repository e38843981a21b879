"""What is served from the facts: nested store documents, badges, headlines, site listings and answers checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.deals import deal_active, minutes_until
from ..functions.numbers import finite, usd
from ..functions.text import escape_html, host_matches, url_host
from ..functions.times import clock_minutes, countdown


def nested_stores(stores: DataFrame, deals: DataFrame) -> DataFrame:
    """Store documents with their deals in order; stores without any keep an empty list.

    A store's deals are a short list by nature; they are gathered by store and never over stores.
    """
    fields = ["deal_id", "description", "start_time", "end_time", "days_valid"]
    lists = deals.groupBy("dispensary_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("deals"))
    joined = stores.join(lists, "dispensary_id", "left")
    kind = lists.schema["deals"].dataType
    return joined.withColumn("deals", F.coalesce("deals", F.array().cast(kind)))


def with_active_deals(documents: DataFrame, day: str, minute: int) -> DataFrame:
    """Documents whose lists hold the active deals only; a store stays with none."""
    keep = lambda d: deal_active(d["days_valid"], d["start_time"], d["end_time"], day, minute)
    return documents.withColumn("deals", F.filter("deals", keep))


def normalized_stores(raw: DataFrame) -> DataFrame:
    """Stores with an id and a usable distance if they state one; a coordinate pair stays only whole."""
    distance = F.col("distance_miles")
    ok = F.col("dispensary_id").isNotNull() & (F.col("dispensary_id") != "") & (distance.isNull() | (finite(distance) & (distance >= 0)))
    pair = finite(F.col("lat")) & finite(F.col("lng"))
    return raw.where(ok).withColumns({"lat": F.when(pair, F.col("lat")), "lng": F.when(pair, F.col("lng"))})


def urgency_badges(deals: DataFrame, minute: int) -> DataFrame:
    """By store the countdown of its first timed happy hour in deal order; 'Active today' without one."""
    timed = (F.col("type") == "happy_hour") & clock_minutes(F.col("start_time")).isNotNull() & clock_minutes(F.col("end_time")).isNotNull()
    told = F.when(timed, countdown(minutes_until(F.col("end_time"), minute)))
    first = F.min_by("_c", F.when(F.col("_c").isNotNull(), F.col("deal_id")))
    return deals.withColumn("_c", told).groupBy("dispensary_id").agg(first.alias("_b")).select("dispensary_id", F.coalesce("_b", F.lit("Active today")).alias("badge"))


def citation_hits(answers: DataFrame, own: str, name: str) -> DataFrame:
    """answers: answer_id, text, urls. Whether the own site is cited or only named, and the distinct hosts."""
    hosts = F.array_sort(F.array_distinct(F.filter(F.transform("urls", url_host), lambda h: h.isNotNull())))
    out = answers.withColumn("hosts", hosts)
    cited = F.exists("hosts", lambda h: host_matches(h, F.lit(own)))
    named = F.lower(F.col("text")).contains(name.lower())
    return out.select("answer_id", F.coalesce(cited, F.lit(False)).alias("cited"), F.coalesce(named & ~cited, F.lit(False)).alias("named_only"), "hosts")


def classification(answer: Column) -> Column:
    """struct(intent, confidence) of a JSON answer; confidence held to 0..1, intent 0 where it is none of 1 to 6."""
    v = F.try_parse_json(answer)
    intent, confidence = F.try_variant_get(v, "$.intent", "int"), F.try_variant_get(v, "$.confidence", "double")
    known = F.when(intent.between(1, 6), intent).otherwise(0)
    held = F.coalesce(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.struct(known.alias("intent"), held.alias("confidence"))


def listed_values(answer: Column, field: str) -> Column:
    """Values of a field that holds one object or many, without repeats."""
    many = F.from_json(answer, f"struct<{field}:array<struct<text:string,value:string>>>")[field]
    one = F.from_json(answer, f"struct<{field}:struct<text:string,value:string>>")[field]
    whole = F.when(F.get_json_object(answer, f"$.{field}").startswith("["), many).otherwise(F.when(one["value"].isNotNull(), F.array(one)))
    return F.array_distinct(F.filter(F.transform(whole, lambda x: x["value"]), lambda v: v.isNotNull()))


def headline(kind: Column, name: Column, low: Column, high: Column, stores: Column) -> Column:
    """One line for a fact, low side first; nothing is promised beyond what was observed."""
    gap = F.concat(name, F.lit(": "), usd(low), F.lit(" to "), usd(high), F.lit(" across "), stores.cast("string"), F.lit(" stores"))
    floor = F.concat(name, F.lit(": from "), usd(low), F.lit(" nearby"))
    return F.when(kind == "regional-floor", floor).when(kind == "disparity", gap).otherwise(F.concat(name, F.lit(": "), usd(low), F.lit(" today")))


def site_entries(paths: DataFrame, base: str) -> DataFrame:
    """paths: path. Lines of a site map, one per distinct path; order is a column and no sort of all."""
    location = escape_html(F.concat(F.lit(base), F.col("path")))
    return paths.select("path").distinct().select("path", F.concat(F.lit("<url><loc>"), location, F.lit("</loc></url>")).alias("entry"))


def region_caveats(floors: DataFrame) -> DataFrame:
    """floors: cluster_id, category, stale. Pages whose floors are all stale carry a caveat."""
    return floors.groupBy("cluster_id", "category").agg(F.count("*").alias("floors"), F.bool_and("stale").alias("caveat"))


def valid_drops(rows: DataFrame) -> DataFrame:
    """Rows of prices below their median that are whole: ids, finite prices over zero, a share under zero."""
    ok = F.col("dispensary_id").isNotNull() & F.col("product_id").isNotNull()
    for name in ("current_price", "median_price"):
        ok = ok & finite(F.col(name)) & (F.col(name) > 0)
    return rows.where(ok & finite(F.col("pct_vs_median")) & (F.col("pct_vs_median") < 0))


def import_once(spark: SparkSession, products: DataFrame, keys: list[str], target: str, force: bool = False) -> int:
    """Write a product table whole: refused where one stands already, unless forced, and where keys repeat. Returns the rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not force and hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop) and spark.read.parquet(target).take(1):
        raise ValueError(f"{target} holds a table already")
    repeated = products.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").take(1)
    if repeated:
        raise ValueError(f"repeated key {repeated[0]}")
    products.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def carded_stores(deals: DataFrame, drops: DataFrame) -> DataFrame:
    """Stores with a card for their deals, and those with drops alone, so that no drop is lost: dispensary_id, source."""
    cards = deals.select("dispensary_id").distinct().withColumn("source", F.lit("deals"))
    others = drops.select("dispensary_id").distinct().withColumn("source", F.lit("drops"))
    return cards.unionByName(others.join(cards, "dispensary_id", "left_anti"))
