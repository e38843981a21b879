"""Queries over whole runs: the nightly derivation, tables kept by key, and streams with timers."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching as fm
from ..functions import text as ft
from ..operators import facts, outreach, ranking, series
from ..sources import adapter
from ..streaming import jobs, states
from . import derivation, increments, keyed
from . import queries as q
from .staging import new_path, staged

COUNTERS = "map<string,bigint>"


def _derived(spark: SparkSession, sf_dir: str) -> tuple[derivation.Run, DataFrame]:
    watched = adapter.series(spark, sf_dir)
    run = derivation.run_over(
        spark, new_path(spark, "run"), adapter.latest_records(spark, sf_dir), watched, places=adapter.stores(spark, sf_dir), deals=adapter.deals(spark, sf_dir),
        record_day=q.TODAY, series_day=q.EVENT_DAY, max_lag_days=q.LAG,
    )
    manifest = derivation.derive(run, f"{q.EVENT_DAY}T00:00:00Z")
    run.close()
    return run, manifest


#: Of each fact, what names a row and the figure that is compared.
ITEMS = {
    "disparities": (["match_key", "weight_grams"], "spread * 100"),
    "deal_scope": (["deal_id", "kind"], "linked"),
    "extraction_health": (["dispensary_id", "status"], "observed_days"),
    "special_events": (["dispensary_id", "product_id", "state"], "1"),
    "rollup_category": (["category", "distinct_stores"], "disparity_count"),
    "rollup_store": (["dispensary_id", "times_priciest"], "times_cheapest"),
    "brand_personas": (["brand_key", "display_brand", "persona"], "special_product_days"),
    "brand_matrix": (["brand_key", "display_brand"], "product_count * 1000 + size(stores_carrying) + size(tiers)"),
    "brand_cells": (["brand_key", "match_key", "weight_grams"], "low_price * 100"),
    "arrivals": (["dispensary_id", "product_id", "outcome"], "absent_runs"),
    "own_median": (["dispensary_id", "product_id", "outcome"], "observed_days"),
    "delivered": (["dispensary_id", "match_key", "weight_grams"], "price * 100"),
    "region_members": (["cluster_id", "dispensary_id"], "1"),
    "region_floors": (["cluster_id", "match_key", "weight_grams"], "store_count_in_cluster"),
    "region_gaps": (["cluster_id", "category"], "1"),
}


def derive_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of one run read back from where the run wrote it, and every counter of its envelopes."""
    run, manifest = _derived(spark, sf_dir)
    counters = manifest.select("fact", F.explode(F.from_json("counters", COUNTERS)).alias("name", "amount"))
    found = counters.select("fact", F.concat(F.lit("counter "), "name").alias("item"), "amount")
    for fact, (names, amount) in ITEMS.items():
        told = [(F.col(c) * 1000).cast("long") if c == "weight_grams" else F.col(c) for c in names]
        item = F.concat_ws(" / ", *[c.cast("string") for c in told])
        found = found.unionByName(run.fact(fact).select(F.lit(fact).alias("fact"), item.alias("item"), F.expr(f"round({amount})").cast("long").alias("amount")))
    return found


def st3_stream_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores going stale by silence: a stream of pushes, run to its end."""
    states.keyed_state(spark)
    pushes = q._event_stream(spark, sf_dir).select(F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("dispensary_id"), F.col("ts").alias("pushed_at"))
    found = q._streamed(states.store_transitions(jobs.closed(pushes, "pushed_at")))
    return found.select("dispensary_id", F.col("at").cast("string").alias("at"), "state")


def st4_stream_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event by which a user is first met, and those by which anew after five days: which it is, and when."""
    states.keyed_state(spark)
    found = q._streamed(states.told_once(q._event_stream(spark, sf_dir), "user_id", "ts", "event_id", keep_days=5))
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("at").cast("string").alias("at"), "event")


def f26_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations against as many phrases as there are turns and documents: the words that these begin with."""
    turns = q._read(spark, sf_dir, "conversations")
    begin = lambda c, n: F.array_join(F.slice(F.split(ft.plain_phrase(F.col(c)), " "), 1, n), " ")
    places = turns.select(begin("text", 3).alias("phrase")).distinct().withColumn("rank", -F.length("phrase"))
    terms = q._read(spark, sf_dir, "documents").select(begin("text", 2).alias("phrase")).distinct().withColumn("rank", F.lit(0))
    posts = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text").dropDuplicates(["id"])
    return outreach.prefilter_by_tables(posts, places, terms).select("id", "geo", "term", "reason")


def s31_area_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes, keywords and nickname of each store's region."""
    towns = adapter.stores(spark, sf_dir).withColumn("label", q._turn(["Bellingham", "Everett", "Mount Vernon", "Seattle", None], F.substring("dispensary_id", 2, 12).cast("int")))
    region = ft.slug(F.col("label"))
    told = lambda c: F.array_join(c, ",")
    return towns.select("dispensary_id", told(fm.area_codes(region)).alias("codes"), told(fm.area_code_keywords(region)).alias("keywords"), fm.area_nickname(region, F.col("label")).alias("nickname"))


AS_OF = [("regional-floor", f"{q.EVENT_DAY} 04:00:00"), ("disparity", "2023-11-01 04:00:00")]


def x12_mention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the fact that answers each: by topic and place, of the brand where one is asked about, as fresh as its run."""
    n = F.col("page_id")
    posts = q._read(spark, sf_dir, "pages").select(n.alias("post_id"), q._turn(q.TOPICS, n).alias("topic"), q._turn(q.ASKED, F.floor(n / 2)).alias("place"), (n % 8).alias("intent"), q._turn(["ring", "BOLT ", "", None], F.floor(n / 8)).alias("brand"))
    dated = spark.createDataFrame(AS_OF, "kind string, as_of string")
    found = facts.mention_candidates(posts, dated, f"{q.EVENT_DAY} 12:00:00", **q._fact_sources(spark, sf_dir))
    return found.select("post_id", "fact", "category", "price", "fact_as_of", "freshness")


HISTORY = "dispensary_id string, product_id string, brand string, last_day date, history array<struct<day:date,observations:bigint>>"


def snk5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their history: days up to the 20th stored, then each later day's products upserted, histories appended."""
    table = keyed.KeyedTable(spark, new_path(spark, "products"), ["dispensary_id", "product_id"], HISTORY, buckets=16)
    daily = staged(series.daily_table(adapter.series(spark, sf_dir)), "daily")
    for low, high in (("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-21"), ("2024-01-22", "2024-12-31")):
        part = daily.where(F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
        seen = F.sort_array(F.collect_list(F.struct("day", "observations"))).alias("history")  # of one product's days in the batch
        batch = part.groupBy("dispensary_id", "product_id").agg(F.max_by("brand", "obs_seq").alias("brand"), F.max("day").alias("last_day"), seen)
        table.upsert(batch, {"history": keyed.appended})
    found = table.read()
    told = F.array_join(F.transform("history", lambda h: F.concat(F.date_format(h["day"], "MMdd"), F.lit(":"), h["observations"].cast("string"))), ",")
    return found.select("dispensary_id", "product_id", "brand", F.col("last_day").cast("string").alias("last_day"), told.alias("history"))


def st7_daily_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own medians kept by increments: a history loaded, then two days appended, touched series recomputed."""
    kept = increments.OwnMedians(spark, new_path(spark, "medians"), buckets=16)
    watched = adapter.series(spark, sf_dir)
    days = [datetime.date(2024, 1, d) for d in (28, 29, 30)]
    kept.load(watched, days[0])
    for before, day in zip(days, days[1:]):
        kept.advance(watched, day, before)
    return kept.read().drop("as_of")


def o7_ranked_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every cell of price gaps in the order of its gap, over the whole table."""
    cells = q._cells(spark, sf_dir).select("match_key", "weight_grams", "spread")
    return ranking.ranked(cells, F.desc("spread"), "match_key", "weight_grams", name="place")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
