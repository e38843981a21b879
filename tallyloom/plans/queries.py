"""Queries over the star-schema test tables, one or more for each family of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import deals as fd
from ..functions import numbers as fn
from ..functions import products as fp
from ..functions import text as ft
from ..operators import brands, disparity, facts, freshness, ingest, outreach, promotions, regions, series
from ..sources import adapter, payloads
from ..streaming import jobs
from .staging import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]

TODAY = "2001-12-31"
LAG = 365
EVENT_DAY = "2024-01-30"
ARRIVAL_DAY = "2024-01-10"
NOW = "2024-01-30 12:00:00"
USER = (47.0, -122.0)
GAS, MPG = 4.5, 25.0
MINUTE, DAY = 17 * 60, "friday"
RIVALS = ["cheap-pills.example.com", "spam-farm.example.org", "example.net"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest records with their gates. They are staged, as the anchor day is read off them too: observations are scanned once."""
    return disparity.gated(staged(adapter.latest_records(spark, sf_dir), "records"), TODAY, LAG)


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disparity.store_offers(disparity.offers(_gated(spark, sf_dir)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells staged, as most facts read them more than once."""
    return staged(disparity.disparities(_best(spark, sf_dir)), "cells")


def d1_disparities(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform("stores_carrying", lambda s: s["dispensary_id"]), ",")
    return _cells(spark, sf_dir).withColumn("stores_carrying", listed)


def d1_gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = staged(_gated(spark, sf_dir), "gated")
    return disparity.gate_counters(gated, disparity.offers(gated))


def d1a_anchor_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disparity.anchor_day(adapter.latest_records(spark, sf_dir), "2001-06-30").select(F.col("anchor").cast("string").alias("anchor"))


def d2_deal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.deal_links(adapter.deals(spark, sf_dir), adapter.latest_records(spark, sf_dir))


def d2_scope_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.scope_products(adapter.deals(spark, sf_dir), adapter.latest_records(spark, sf_dir))


def d2_link_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.link_counters(d2_deal_links(spark, sf_dir))


def d3_extraction_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.series(spark, sf_dir)
    roster = s.select("dispensary_id").distinct().unionByName(spark.createDataFrame([("v-none",)], "dispensary_id string"))
    return series.extraction_health(s, roster, EVENT_DAY)


def d4_special_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.special_states(adapter.series(spark, sf_dir), EVENT_DAY)


def d4_special_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d4_special_states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def d5_rollup_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disparity.rollup_by_category(_cells(spark, sf_dir))


def d5_rollup_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = adapter.stores(spark, sf_dir)
    out = disparity.rollup_by_store(_cells(spark, sf_dir), geo)
    return out.withColumn("lat", fn.r4(F.col("lat"))).withColumn("lng", fn.r4(F.col("lng")))


def d6_brand_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.series(spark, sf_dir).where(F.col("day") <= F.lit(EVENT_DAY).cast("date"))
    days = series.last_of_day(s, ["dispensary_id", "product_id"], "special", ["obs_seq"]).withColumnRenamed("value", "special")
    products = s.select("dispensary_id", "product_id", "brand").distinct()
    out = brands.personas(days, products)
    return out.withColumn("special_day_fraction", fn.r4(F.col("special_day_fraction")))


def _brand_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced options of all records with a brand, keyed but not gated by flags or freshness."""
    price = fn.price_of_record(F.col("special_price"), F.col("base_price"))
    return adapter.latest_records(spark, sf_dir).select(
        "brand",
        "dispensary_id",
        "product_id",
        "name",
        "match_key",
        "weight_grams",
        price.alias("price"),
    ).where(fn.positive(F.col("price")) & F.col("weight_grams").isNotNull())


def d7_brand_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brands.availability(_brand_offers(spark, sf_dir))
    return out.select(
        "brand_key", "product_count", F.array_join("stores_carrying", ",").alias("stores_carrying"), F.array_join(F.transform("tiers", lambda t: t.cast("int").cast("string")), ",").alias("tiers")
    )


def d7_cheapest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _brand_offers(spark, sf_dir).withColumn("brand_key", fp.brand_key(F.col("brand"))).where("brand_key is not null")
    best = F.min(F.struct("price", "product_id", "name"))
    keyed = keyed.repartition("brand_key", "match_key", "weight_grams")  # serves both groupings
    per_store = keyed.groupBy("brand_key", "match_key", "weight_grams", "dispensary_id").agg(best.alias("o")).select(
        "brand_key", "match_key", "weight_grams", "dispensary_id", "o.price", "o.name"
    )
    return brands.cheapest_cells(per_store).withColumn("cheapest_stores", F.array_join("cheapest_stores", ","))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.series(spark, sf_dir)
    health = series.extraction_health(s, s.select("dispensary_id").distinct(), ARRIVAL_DAY)
    return series.arrivals_and_dormancy(s, health, ARRIVAL_DAY)


def d8_new_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(spark, sf_dir).where("outcome = 'arrival'").select("dispensary_id", "product_id", F.col("first_seen").cast("string").alias("first_seen"))


def d8_dormant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(spark, sf_dir).where("outcome = 'dormant'").select("dispensary_id", "product_id", F.col("last_seen").cast("string").alias("last_seen"), "absent_runs")


def d8_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


def d9_price_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.own_median(adapter.series(spark, sf_dir), ["dispensary_id", "product_id"], EVENT_DAY)
    return found.where("outcome in ('below-median', 'above-median')").drop("outcome")


def d9_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.own_median(adapter.series(spark, sf_dir), ["dispensary_id", "product_id"], EVENT_DAY)
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


def d10_delivered_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disparity.delivered_offers(_cells(spark, sf_dir), adapter.stores(spark, sf_dir))
    return out.withColumn("lat", fn.r4(F.col("lat"))).withColumn("lng", fn.r4(F.col("lng")))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.clusters(adapter.stores(spark, sf_dir))


def _floors(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    flat = disparity.flat_offers(_cells(spark, sf_dir)).select("match_key", "weight_grams", "display_name", "category", "dispensary_id", "price")
    return regions.floors(flat, members)


def d11_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _floors(spark, sf_dir, _members(spark, sf_dir)).withColumn("floor_stores", F.array_join("floor_stores", ","))


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighty presence: categories of which a store holds more than a twelfth of its menu, so that gaps exist."""
    counts = adapter.latest_records(spark, sf_dir).groupBy("dispensary_id", "category").agg(F.count("*").alias("n"))
    total = Window.partitionBy("dispensary_id")
    return counts.withColumn("t", F.sum("n").over(total)).where("n * 6 > t").select("dispensary_id", "category")


def d11_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = adapter.stores(spark, sf_dir).select("dispensary_id", F.when(F.col("balance") < -800, "suspected-extraction-failure").otherwise("ok").alias("status"))
    return regions.gaps(_presence(spark, sf_dir), _members(spark, sf_dir), status)


def d12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("cluster_id", "dispensary_id")


def d12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regions.centroids(_members(spark, sf_dir))
    return out.select("cluster_id", "store_count", fn.r2(F.col("centroid_lat")).alias("centroid_lat"), fn.r2(F.col("centroid_lng")).alias("centroid_lng"))


def d13_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = adapter.stores(spark, sf_dir).select("dispensary_id", ft.city_of(F.col("address")).alias("city"))
    return regions.regions(_members(spark, sf_dir), cities)


def d13_standing_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = adapter.stores(spark, sf_dir).select("dispensary_id", F.when(F.col("balance") < 2000, "stale").otherwise("ok").alias("status"))
    out = regions.standing_floors(_floors(spark, sf_dir, _members(spark, sf_dir)), status)
    return out.withColumn("floor_stores", F.array_join("floor_stores", ","))


def w1_day_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = series.last_of_day(adapter.series(spark, sf_dir), ["product_id"], "special", ["obs_seq"])
    out = series.day_walk(daily, ["product_id"], "2024-01-05", "2024-01-20")
    return out.select("product_id", F.col("day").cast("string").alias("day"), "status", "value", "previous")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sessions(adapter.citations(spark, sf_dir), ["engine"], "checked_at", ["check_id"])


def w11_session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("engine", "run").agg(F.count("*").alias("checks"))


def w12_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = adapter.citations(spark, sf_dir).withColumn("run", F.to_date("checked_at").cast("string"))
    share = outreach.citation_share(daily).select("run", fn.r4(F.col("share")).alias("share"))
    return outreach.trend(share, "run", "share").withColumn("delta", fn.r4(F.col("delta")))


def w13_first_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = adapter.citations(spark, sf_dir).withColumn("run", F.to_date("checked_at").cast("string"))
    return outreach.first_citations(daily)


def a14_citation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = adapter.citations(spark, sf_dir).withColumn("run", F.to_date("checked_at").cast("string"))
    return outreach.citation_share(daily).withColumn("share", fn.r4(F.col("share")))


def a15_rival_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.rival_ranking(adapter.citations(spark, sf_dir), "site0.example")


def a16_engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.engine_summary(adapter.citations(spark, sf_dir))


def o2_top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disparity.top_gaps(_cells(spark, sf_dir)).select("match_key", "weight_grams", "low_price", "high_price", "spread")


def o5_store_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.own_median(adapter.series(spark, sf_dir), ["dispensary_id", "product_id"], EVENT_DAY)
    drops = found.where("outcome = 'below-median'").withColumn("drop_percent", fn.drop_percent(F.col("pct_vs_median"))).where("drop_percent <> 0")
    deepest = Window.partitionBy("dispensary_id").orderBy("pct_vs_median", "product_id")
    return drops.withColumn("place", F.row_number().over(deepest)).where("place <= 12").select("dispensary_id", "product_id", "pct_vs_median", "drop_percent", "place")


def o7_deal_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = promotions.active_deals(promotions.usable_deals(adapter.deals(spark, sf_dir)), DAY, MINUTE)
    places = adapter.stores(spark, sf_dir)
    miles = fn.road_miles(F.lit(USER[0]), F.lit(USER[1]), F.col("lat"), F.col("lng"))
    near = places.select("dispensary_id", F.when(F.col("balance") > 0, fn.r4(miles)).alias("distance_miles"))
    return promotions.feed(active, near, MINUTE).select("dispensary_id", "deal_id", "deal_rank", "store_rank")


def o14_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disparity.endpoints(_cells(spark, sf_dir))


def j6_geo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir)
    ours = s.where("balance > 0").select("dispensary_id", F.when(F.col("balance") > 5000, F.col("lat")).alias("lat"), "lng")
    theirs = s.where("balance < 7000").select("dispensary_id", (F.col("lat") + 0.5).alias("lat"), "lng", (F.col("balance") > 6000).alias("overlap"))
    out = regions.geo_lookup(ours, theirs)
    return out.select("dispensary_id", fn.r4(F.col("lat")).alias("lat"), fn.r4(F.col("lng")).alias("lng"))


def j9_pairs_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.pairs_within(adapter.stores(spark, sf_dir)).withColumn("miles", fn.r4(F.col("miles")))


def m2_unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapter.latest_records(spark, sf_dir)
    grams = fp.grams_of(F.col("option"))
    return r.select(
        "dispensary_id",
        "product_id",
        fn.per_gram(F.col("base_price"), grams).alias("price_per_gram"),
        fn.per_gram(F.col("special_price"), grams).alias("special_price_per_gram"),
        fn.per_item(F.col("base_price"), F.lit(5)).alias("price_per_item"),
    )


def m5_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir)
    miles = fn.road_miles(F.lit(USER[0]), F.lit(USER[1]), F.col("lat"), F.col("lng"))
    return s.select(
        "dispensary_id", fn.r4(miles).alias("road_miles"), fn.r4(fn.round_trip_gas_cost(miles, F.lit(GAS), F.lit(MPG))).alias("gas_cost")
    )


def m8_delivered_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = disparity.delivered_offers(_cells(spark, sf_dir), adapter.stores(spark, sf_dir))
    out = regions.delivered(offers, *USER, GAS, MPG)
    return out.select("match_key", "weight_grams", "dispensary_id", "price", fn.r2(F.col("total")).alias("total"))


def m11_discount_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.deals(spark, sf_dir).withColumn("pct", F.col("discount_pct") * 4)
    return d.groupBy(fn.discount_tier(F.col("pct")).alias("tier")).agg(F.count("*").alias("n"))


LABELS = ["1/8oz", "1/4oz", "1/2oz", "1oz", "3.5g", "1g", "100mg", "2", "1/0oz", "4mg", "3.6g", "abc", "28g"]


def s3_canonical_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams and canonical grams of a label for each part, labels by turns."""
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_partkey") % len(LABELS)).cast("int"))
    p = _read(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return p.select("p_partkey", "label", fp.grams_of(F.col("label")).alias("grams"), fp.canonical_grams(F.col("label")).alias("canonical"))


def s7_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.catalog(spark, sf_dir)
    key = fp.match_key(F.concat(F.lit("3.5g 2pk "), F.col("name"), F.lit(" Pre-Roll 707 OG OG")), F.col("brand"), F.lit("Hybrid"), F.col("category"), F.col("subcategory"))
    return c.select("product_id", key.alias("match_key"), fp.brand_key(F.col("brand")).alias("brand_key"))


def s9_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", ft.clean_description(F.col("text")).alias("description"))


def s12_deal_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.deals(spark, sf_dir).select("deal_id", "description")
    return promotions.by_text(d, s=fd.deal_scope(F.col("description"))).select("deal_id", "s.*")


def s13_deal_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = adapter.deals(spark, sf_dir).select("deal_id", "description"), F.col("description")
    found = promotions.by_text(d, icons=F.array_join(fd.deal_icons(text), ","), categories=F.array_join(fd.deal_categories(text), ","))
    return found.select("deal_id", "icons", "categories")


def s16_deal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.deals(spark, sf_dir)
    return d.select("deal_id", fd.without_discount(F.col("description"), F.col("discount_pct")).alias("title"))


def s19_deal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = adapter.deals(spark, sf_dir).withColumn("title", fd.without_discount(F.col("description"), F.col("discount_pct")))
    return promotions.deal_blocks(titled).drop("low", "high")


def s20_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.catalog(spark, sf_dir)
    return c.select("product_id", ft.slug(F.concat_ws(" & ", "brand", "name")).alias("slug"))


def s21_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.stores(spark, sf_dir).select("dispensary_id", ft.city_of(F.col("address")).alias("city"))


def s25_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    return p.groupBy(ft.url_host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def s26_mention_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", ft.mention_key(F.col("url")).alias("mention_key"))


def s28_inventory_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.inventory_tokens(_read(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


def f1_active_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.active_deals(adapter.deals(spark, sf_dir).where(fd.usable_window(F.col("start_time"), F.col("end_time"))), DAY, MINUTE).select("deal_id", "dispensary_id")


def f5_usable_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.usable_deals(adapter.deals(spark, sf_dir)).select("deal_id", "description")


def f21_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.deals(spark, sf_dir).select("deal_id", "description")
    return promotions.selected_deals(d, "vape").select("deal_id")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("ts").cast("string")
    e = _read(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 40).alias("store")).agg(last.alias("last_fetched_at")).withColumn(
        "last_fetched_at", F.when(F.col("store") % 13 == 0, "never").otherwise(F.col("last_fetched_at"))
    )


def f9_store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fetched(spark, sf_dir)
    at = F.col("last_fetched_at")
    now = "2024-01-31 00:00:00"
    return f.select("store", freshness.store_status(at, now).alias("status"), freshness.deals_expired(at, now).alias("expired"), freshness.run_freshness(at, now).alias("run"))


def f24_off_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rivals = spark.createDataFrame([(r,) for r in RIVALS], "domain string")
    return outreach.off_channel(_read(spark, sf_dir, "pages").select("page_id", "url"), rivals).select("page_id")


def f26_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return outreach.prefilter(c, ["the", "der", "la"], ["is", "und", "de"]).select("id", "geo", "term", "reason")


def f32_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.alert(_fetched(spark, sf_dir), "2024-01-31 00:00:00")


def src16_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.catalog(spark, sf_dir)
    return c.select("product_id", payloads.category_of(F.concat(F.lit("Menu / "), F.col("category"), F.lit("s"))).alias("category"))


def src17_brand_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.catalog(spark, sf_dir)
    made = ft.slug(F.concat_ws(" ", "brand", F.split_part("name", F.lit(" "), F.lit(1)), F.lit("cart"), "product_id"))
    return c.select("product_id", payloads.brand_from_slug(made, F.lit("cart-vape")).alias("brand"))


def src22_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, F.lit(" Tues & sat")).when(F.col("p_size") % 3 == 1, F.lit(" on Sunday only")).otherwise(F.lit(" tuesdayish")))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(payloads.weekdays_in(text), ",").alias("days"))


def src27_clock_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    text = F.concat(F.lit("Happy hour "), (n % 12 + 1).cast("string"), F.lit(":30-"), ((n + 2) % 12 + 1).cast("string"), F.when(n % 2 == 0, "pm").otherwise("am"))
    return _read(spark, sf_dir, "part").select("p_partkey", payloads.clock_window(text).alias("w")).select("p_partkey", "w.*")


def src29_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return p.select("page_id", payloads.plain_html(title).alias("title"))


def src31_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.series(spark, sf_dir)
    primary = s.where("special").groupBy("dispensary_id", "product_id").agg(F.count("*").alias("n")).withColumn("source", F.lit("site"))
    fallback = s.groupBy("dispensary_id", "product_id").agg(F.count("*").alias("n")).withColumn("source", F.lit("menu"))
    return payloads.primary_or_fallback(primary, fallback, "product_id")


def src40_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir)
    old = s.select("dispensary_id", F.when(F.col("balance") > 3000, F.col("lat")).alias("lat"), F.when(F.col("balance") > 3000, F.col("lng")).alias("lng"))
    found = s.select("dispensary_id", (F.col("lat") + 1).alias("lat"), "lng")
    out = payloads.filled_places(old, found)
    return out.select("dispensary_id", fn.r4(F.col("lat")).alias("lat"), fn.r4(F.col("lng")).alias("lng"))


def js1_loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    told = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: "), F.col("props"), F.lit(" done"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("no json"))
    return e.select("event_id", F.try_variant_get(payloads.loose_json(told), "$.k", "int").alias("k"))


def snk2_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append of the days from the 15th writes when everything up to the 20th is stored."""
    s = adapter.series(spark, sf_dir).select("product_id", F.col("observed_at").cast("string").alias("observed_at"), "day", "obs_seq")
    stored = s.where(F.col("day") <= F.lit("2024-01-20").cast("date"))
    incoming = s.where(F.col("day") >= F.lit("2024-01-15").cast("date"))
    return ingest.new_observations(stored, incoming.unionByName(incoming), ["product_id", "observed_at"]).select("product_id", "observed_at", "obs_seq")


def snk7_ingest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir).select("dispensary_id", F.lit("2024-01-01").alias("last_fetched_at"), F.lit(False).alias("stale"))
    n = F.col("s_suppkey")
    entries = _read(spark, sf_dir, "supplier").select(
        F.concat(F.when(n % 7 == 0, "x").otherwise("s"), n.cast("string")).alias("dispensary_id"), (n % 3).alias("deal_count"), (n % 2 == 0).alias("confirmed_empty")
    ).where("deal_count < 2")
    return ingest.merged_stores(s, ingest.ingest_outcomes(s, entries), "2024-01-30")


def snk7_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir).select("dispensary_id")
    n = F.col("s_suppkey")
    entries = _read(spark, sf_dir, "supplier").select(
        F.concat(F.when(n % 7 == 0, "x").otherwise("s"), n.cast("string")).alias("dispensary_id"), (n % 3).alias("deal_count"), (n % 2 == 0).alias("confirmed_empty")
    )
    return ingest.ingest_outcomes(s, entries).groupBy("outcome").agg(F.count("*").alias("n"))


def src2_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from an instant on with their product: filter and columns reach the scan."""
    o = adapter.observations(spark, sf_dir).where(F.col("observed_at") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    c = adapter.catalog(spark, sf_dir).select("partkey", "product_id", "name", "category")
    joined = o.join(c, "partkey")
    return joined.select("dispensary_id", "product_id", "name", "category", "obs_seq", F.col("observed_at").cast("string").alias("observed_at"), "base_price", "special_price")


def jes5_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw products made from parts, normalized: pack counts, flags and unit prices of the first option."""
    n = F.col("p_partkey")
    options = F.array(F.struct(F.concat(F.col("p_size").cast("string"), F.lit("g")).alias("option"), F.col("p_retailprice").alias("base_price"), F.lit(None).cast("double").alias("special_price"), F.lit(1.0).alias("quantity_available")))
    two = F.concat(options, F.array(F.struct(F.lit("7g").alias("option"), F.col("p_retailprice").alias("base_price"), F.lit(None).cast("double").alias("special_price"), F.lit(1.0).alias("quantity_available"))))
    raw = adapter.catalog(spark, sf_dir).select("product_id", "partkey", "name", "category").join(_read(spark, sf_dir, "part"), F.col("partkey") == n)
    raw = raw.select(
        "product_id",
        F.concat("name", F.when(n % 3 == 0, " 2pk").otherwise("")).alias("name"),
        "category",
        F.lit(1000.0).alias("weight_field"),
        (F.col("p_size") * F.when(n % 5 == 0, 900.0).otherwise(1000.0)).alias("net_weight_mg"),
        F.when(n % 4 == 0, two).otherwise(options).alias("options"),
    )
    out = ingest.normalize_products(raw)
    first = F.get("options", F.lit(0))
    return out.select("product_id", "pack_count", F.array_join("flags", ",").alias("flags"), first["price_per_gram"].alias("price_per_gram"), first["price_per_item"].alias("price_per_item"))


def t3_category_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = staged(_presence(spark, sf_dir), "presence")
    stores = present.select("dispensary_id").distinct()
    return stores.crossJoin(F.broadcast(present.select("category").distinct())).join(present, ["dispensary_id", "category"], "left_anti")


def t5_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).select(F.concat(F.lit("/compare/"), ft.slug(F.col("category"))).alias("path"))
    s = adapter.stores(spark, sf_dir).select(F.concat(F.lit("/store/"), ft.slug(F.col("name"))).alias("path"))
    return c.unionByName(s).distinct()


TOPICS = ["cheapest flower", "carts", "edibles", "flow", "credible", "", None, "Concentrates and vapes", "Pre-Rolls"]
ASKED = ["", "WA", "Portland", "Seattle", "City 3", "city-7", " CITY 12 ", "gotham", None, "Kent, ID"]
SNIPPETS = ["seen in Kent", "near City 4", "from Boise to Kent", "in or around nothing", None]
SOLD = ["Flower", "Vaporizers", "Edible", "Concentrate", "Edible", "Pre-Rolls", "Edible"]


def _turn(values: list[str | None], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values)).cast("int"))


def _fact_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Floors, gaps, drops and names of places; the drops are those of the event series, told by store and category."""
    places, cells = adapter.stores(spark, sf_dir), _cells(spark, sf_dir)
    members = staged(_members(spark, sf_dir), "members")
    cities = places.select("dispensary_id", ft.city_of(F.col("address")).alias("city"))
    found = staged(regions.regions(members, cities), "regions")
    of_region = found.select("cluster_id", F.col("slug").alias("region"))
    status = places.select("dispensary_id", F.when(F.col("balance") < 2000, "stale").otherwise("ok").alias("status"))
    flat = disparity.flat_offers(cells).select("match_key", "weight_grams", "display_name", "category", "dispensary_id", "price")
    medians = series.own_median(adapter.series(spark, sf_dir), ["dispensary_id", "product_id"], EVENT_DAY).where("outcome = 'below-median'")
    user = F.split_part("product_id", F.lit("-"), F.lit(1)).cast("int")
    drops = medians.withColumn("dispensary_id", F.replace("dispensary_id", F.lit("v"), F.lit("s"))).withColumn("category", _turn(SOLD, user)).withColumnRenamed("product_id", "name")
    return {
        "floors": regions.standing_floors(regions.floors(flat, members), status).join(of_region, "cluster_id"),
        "gaps": cells,
        "drops": drops.join(members.join(of_region, "cluster_id").select("dispensary_id", "region"), "dispensary_id", "left"),
        "names": staged(facts.place_names(found, members, cities), "names"),
    }


def x1_select_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact that answers each topic and place asked for, or why none does."""
    n = F.col("page_id")
    asks = _read(spark, sf_dir, "pages").select(_turn(TOPICS, n).alias("topic"), _turn(ASKED, n).alias("place"))
    out = facts.select_facts(asks, **_fact_sources(spark, sf_dir))
    return out.select("topic", "place", "place_kind", "region", "kind", "category", "weight_grams", "price", "against_price", "drop_percent", "reason")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    posted = F.date_sub(F.lit(EVENT_DAY).cast("date"), (n % 120).cast("int"))
    return _read(spark, sf_dir, "pages").select(
        "page_id", "url", F.lit("Where to buy").alias("title"), _turn(SNIPPETS, n).alias("snippet"), _turn(TOPICS, F.floor(n / 5)).alias("topic"), _turn(ASKED, F.floor(n / 3)).alias("geo"),
        F.when(n % 11 != 0, posted.cast("string")).otherwise("unknown").alias("posted"),
    )


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rivals = spark.createDataFrame([(r,) for r in RIVALS], "domain string")
    return facts.paired(_candidates(spark, sf_dir), rivals=rivals, now=f"{EVENT_DAY} 00:00:00", topic="flow", **_fact_sources(spark, sf_dir))


def x3_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("page_id", "kind", "category", fn.r4(F.col("fit_score")).alias("fit_score"))


def x3_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _paired(spark, sf_dir).withColumn("fit_score", fn.r4(F.col("fit_score")))
    return facts.worklist(pairs, 10).select("url", "kind", "fit_score")


def x3_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.worklist_counters(_candidates(spark, sf_dir), _paired(spark, sf_dir))


def j18_brand_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each gap's product is about a brand that a thread may name."""
    named = _turn(["ring", "BOLT ", "", "o"], F.length("display_name"))
    return _cells(spark, sf_dir).select("match_key", "weight_grams", facts.concerns_brand(F.col("display_name"), named).alias("concerns"))


def x4_chase_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    mentions = p.select("url", F.lit("Menu list").alias("title"), F.when(F.col("page_id") % 3 == 0, "The Tally-Loom is here").otherwise("none").alias("snippet"), F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("posted"))
    known = p.where("page_id % 10 = 0").select(ft.mention_key(F.col("url")).alias("key"))
    rivals = spark.createDataFrame([(r,) for r in RIVALS], "domain string")
    linking = spark.createDataFrame([("therha.example.com",)], "domain string")
    return outreach.chase_list(mentions, known, rivals, linking, "example.org", ["tallyloom"]).select("key", "posted")


def x5_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    classified = e.select((F.col("user_id")).alias("post_id"), F.col("event_id").alias("position"), (k % 8).alias("intent"), (k / 100).alias("confidence"), F.when(F.col("event_type") != "error", "fact").alias("fact"))
    seen = e.where("user_id % 9 = 0").select(F.col("user_id").alias("post_id"))
    return outreach.alerts(classified, seen).select("post_id", "position", "intent")


def st5_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session runs by a streaming query over the events, run to the end; a closing row lets the last sessions out."""
    runs = jobs.session_runs(jobs.closed(_event_stream(spark, sf_dir), "ts"), ["event_type"])
    return _streamed(runs).select("event_type", F.col("started").cast("string").alias("started"), "checks")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(_read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(stream: DataFrame) -> DataFrame:
    """What a streaming query writes until its source is used up."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/tallyloom/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def st6_stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _event_stream(spark, sf_dir).withColumn("dispensary_id", F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string"))).withColumn("product_id", F.concat_ws("-", "user_id", "event_type"))
    daily = _streamed(jobs.daily_presence(jobs.closed(seen, "ts"))).where("dispensary_id is not null")
    return daily.withColumn("day", F.col("day").cast("string"))


def st4_stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(jobs.first_seen(_event_stream(spark, sf_dir).select("user_id", "ts"), "user_id", "ts")).select("user_id")


QUERIES: dict[str, Query] = {
    name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name not in ("Query",)
}
