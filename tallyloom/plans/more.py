"""Further queries: predicates, phrases, rankings, set operations and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import matching as fm
from ..functions import numbers as fn
from ..functions import products as fp
from ..functions import text as ft
from ..functions import times as fd
from ..operators import disparity, freshness, ingest, outreach, promotions, regions, series, serving
from ..sources import adapter, payloads
from . import queries as q

PLACES = ["Seattle", "Portland, OR", "City 3", "statewide", "Paris", "", "Boise WA", "Washington"]
AGENTS = ["Mozilla Googlebot/2.1", "GPTBot", "curl", "my-Spider x", "applebot-extended", "Applebot", ""]
LINKS = ["https://www.reddit.com/r/abc_1/x", "http://old.reddit.com/", "https://news.example.com/a", "http://x.gov", "https://cs.some.edu/b", "https://plain.com", "nope"]
TOPICS = ["cheapest flowers", "vape carts", "gummies", "credible", "", "concentrate wax", "pre rolls"]


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def f3_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.deals(spark, sf_dir)
    return d.where(fd.window_open(F.col("start_time"), F.col("end_time"), q.MINUTE)).select("deal_id")


def f14_price_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = fn.positive(F.col("price"))
    return adapter.series(spark, sf_dir).groupBy("dispensary_id").agg(F.count_if(ok).alias("usable"), F.count_if(~ok).alias("unusable"))


def f15_renderable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disparity.renderable(q._cells(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


def f22_near_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir)
    miles = F.when(F.col("balance") > 0, fn.road_miles(F.lit(q.USER[0]), F.lit(q.USER[1]), F.col("lat"), F.col("lng")))
    return s.withColumn("miles", miles).where("miles is null or miles <= 150").select("dispensary_id")


def f23_expired_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    expired = freshness.deals_expired(F.col("last_fetched_at"), "2024-01-31 00:00:00")
    return q._fetched(spark, sf_dir).groupBy(expired.alias("expired")).agg(F.count("*").alias("stores"))


def f29_crawlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return q._read(spark, sf_dir, "part").select("p_partkey", fm.agent(_pick(AGENTS, n)).alias("agent"))


def f30_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(s) for s in (200, 301, 404, 410, 503, 429)]), (F.col("page_id") % 6).cast("int"))
    url = F.when(F.col("page_id") % 7 != 0, F.col("url"))
    return q._read(spark, sf_dir, "pages").select("page_id", fm.probe_verdict(url, status).alias("verdict"))


def f36_narrow_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fact about specials may see: no prices."""
    return adapter.series(spark, sf_dir).select("product_id", "brand", F.col("day").cast("string").alias("day"), "special")


def f37_priced_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a priced option, and with one at an eighth; sold out ones count."""
    r = adapter.latest_records(spark, sf_dir)
    priced = fn.positive(fn.price_of_record(F.col("special_price"), F.col("base_price")))
    at = F.col("weight_grams")
    return r.groupBy("category").agg(F.count_if(priced).alias("priced"), F.count_if(priced & (at == 28.0)).alias("priced_ounce"))


def j12_region_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = adapter.stores(spark, sf_dir).select("dispensary_id", F.when(F.col("balance") < 2000, "stale").otherwise("ok").alias("status"))
    joined = q._members(spark, sf_dir).join(status, "dispensary_id", "left")
    return joined.groupBy("cluster_id").agg(F.count_if(F.col("status") == "ok").alias("alive"), F.bool_and(F.col("status") == "stale").alias("all_stale"))


def j14_no_drop_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores carded for their deals, and stores with drops that have no card."""
    return serving.carded_stores(adapter.deals(spark, sf_dir), adapter.observations(spark, sf_dir).where("special"))


def m12_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q._read(spark, sf_dir, "part").select("p_partkey", fn.r4(fm.uniform32(F.col("p_partkey"))).alias("u"))


def m9_drop_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = q._cells(spark, sf_dir)
    return c.select("match_key", "weight_grams", fn.multiple_phrase(F.col("spread_pct")).alias("phrase"), fn.usd(F.col("low_price")).alias("price"))


def o3_category_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category the hundred widest gaps in dollars, with the number in all; ranks are cut before they are shuffled."""
    cells = q._cells(spark, sf_dir)
    widest = Window.partitionBy("category").orderBy(F.desc("spread"), "match_key", "weight_grams")
    top = cells.withColumn("place", F.row_number().over(widest)).where("place <= 100")
    totals = cells.groupBy("category").agg(F.count("*").alias("total"))
    return top.join(totals, "category").select("category", "place", "match_key", "weight_grams", "spread", "total")


def o4_region_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cluster and category the three lowest floors."""
    f = q._floors(spark, sf_dir, q._members(spark, sf_dir))
    axis = Window.partitionBy("cluster_id", "category").orderBy("floor_price", "match_key", "weight_grams")
    return f.withColumn("place", F.row_number().over(axis)).where("place <= 3").select("cluster_id", "category", "place", "match_key", "weight_grams", "floor_price")


def o6_cheapest_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = disparity.rollup_by_store(q._cells(spark, sf_dir), adapter.stores(spark, sf_dir)).where("times_cheapest > 0")
    return by.orderBy(F.desc("times_cheapest"), "dispensary_id").limit(5).select("dispensary_id", "times_cheapest")


def o12_top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disparity.rollup_by_category(q._cells(spark, sf_dir)).orderBy(F.desc("avg_spread_pct"), "category").limit(1).select("category", "avg_spread_pct")


def a12_widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = q._cells(spark, sf_dir)
    return c.groupBy("category").agg(F.min_by(F.struct("match_key", "weight_grams", "spread_pct"), F.struct((-F.col("spread_pct")).alias("s"), "match_key", "weight_grams")).alias("o")).select("category", "o.*")


def a17_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of fired alerts acted on, by intent, in whole percent."""
    e = adapter.citations(spark, sf_dir)
    rate = F.floor(F.try_divide(F.count_if("cited"), F.count("*")) * 100 + 0.5)
    return e.groupBy("question").agg(F.count("*").alias("fired"), F.count_if("cited").alias("acted"), rate.alias("precision"))


def s1_pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.catalog(spark, sf_dir)
    name = F.concat("name", F.when(F.col("partkey") % 3 == 0, F.concat(F.lit(" "), (F.col("partkey") % 7).cast("string"), F.lit("pk"))).otherwise(" 5 packed"))
    return c.select("product_id", fp.pack_count(name).alias("pack_count"))


def s5_stripped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("1/8 oz 707 "), F.col("p_name"), F.lit(" 3.5g 2.5"))
    return q._read(spark, sf_dir, "part").select("p_partkey", ft.plain_phrase(fp.without_measurements(name)).alias("name"))


def s22_escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return q._read(spark, sf_dir, "pages").select("page_id", ft.escape_html(title).alias("title"))


def s23_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.catalog(spark, sf_dir)
    return c.select("product_id", fm.topic_fits(_pick(TOPICS, F.col("partkey")), F.col("category")).alias("fits"))


def s24_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(F.lit("city-3"), F.lit("city-4"))
    return q._read(spark, sf_dir, "part").select("p_partkey", fm.place_kind(_pick(PLACES, F.col("p_partkey")), known).alias("kind"))


def s30_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q._read(spark, sf_dir, "part").select("p_partkey", fm.channel(_pick(LINKS, F.col("p_partkey"))).alias("channel"))


def s34_store_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = adapter.catalog(spark, sf_dir).groupBy("category").agg(F.sort_array(F.collect_set("subcategory")).alias("names"))
    return names.select("category", ft.join_names(F.concat(F.array(ft.title_case(ft.slug(F.col("category")))), "names")).alias("listed"))


def s37_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir)
    return s.select("dispensary_id", F.concat(F.lit("/store/"), ft.slug(F.concat_ws(" ", "name", "dispensary_id"))).alias("path"))


def dt3_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.deals(spark, sf_dir).select("start_time", "end_time").distinct()
    start, end = F.col("start_time"), F.col("end_time")
    left = F.pmod(fd.clock_minutes(end) - q.MINUTE, F.lit(1440))
    return d.select("start_time", "end_time", fd.window_text(start, end).alias("window_text"), fd.countdown(left).alias("countdown"))


def dt5_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = q._read(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("string"))
    return e.select(
        "event_id",
        fd.freshness_sentence(at, F.col("event_id") % 3 == 0).alias("sentence"),
        fd.fact_freshness(at, q.NOW).alias("fact"),
        fd.artifact_stale(at, q.NOW).alias("artifact_stale"),
    )


def src1_full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation of every known product in order, with the product's identity; orphans are left out."""
    o = adapter.observations(spark, sf_dir).withColumn("observed_at", F.col("observed_at").cast("string"))
    known = adapter.catalog(spark, sf_dir).select("partkey", "product_id", "name", "category")
    out = ingest.histories(o, known, ["dispensary_id", "partkey"], "obs_seq", "partkey")
    return out.select("dispensary_id", "product_id", "name", "category", "position", "obs_seq", "observed_at", "base_price", "special_price", "quantity_available")


def src7_api_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with the number of their active deals; stores without any stay."""
    active = promotions.active_deals(promotions.usable_deals(adapter.deals(spark, sf_dir)), q.DAY, q.MINUTE).groupBy("dispensary_id").agg(F.count("*").alias("n"))
    return adapter.stores(spark, sf_dir).select("dispensary_id").join(active, "dispensary_id", "left").select("dispensary_id", F.coalesce("n", F.lit(0)).alias("active_deals"))


def src12_first_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = q._read(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("size"))
    return payloads.first_nonempty(e.withColumn("size", F.col("size") - 50), "user_id", "event_id", "size")


def src39_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir)
    old = s.select("dispensary_id", F.lit(4.5).alias("price"))
    new = s.where("balance < 8000").select("dispensary_id", (F.col("balance") / 1000).alias("price"))
    return ingest.kept_reference(old, new, "dispensary_id", "price")


def src41_zip_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" 98"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.when(F.col("n_nationkey") % 3 == 0, "-1234").when(F.col("n_nationkey") % 3 == 1, "x").otherwise(""))
    return q._read(spark, sf_dir, "nation").select("n_nationkey", payloads.zip_key(raw).alias("zip"))


def src43_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adapter.stores(spark, sf_dir).where("balance > 0").select("dispensary_id")
    b = adapter.observations(spark, sf_dir).where("special").select("dispensary_id")
    return a.union(b).distinct()


def src44_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 10 == 1, " ").when(F.col("event_id") % 10 == 2, '{"z": 1}').otherwise(F.col("props"))
    return payloads.log_rows(q._read(spark, sf_dir, "events").select(line.alias("value")), "k:int", ["k"])[1]


def src55_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines fired and acted on in an alert log; malformed lines fired too."""
    line = F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 10 == 1, "").otherwise(F.concat(F.lit('{"acted": '), (F.col("value") > 20).cast("string"), F.lit("}")))
    told = q._read(spark, sf_dir, "events").select(line.alias("value")).where("trim(value) <> ''")
    acted = F.try_variant_get(F.try_parse_json(F.col("value")), "$.acted", "boolean")
    return told.agg(F.count("*").alias("fired"), F.count_if(F.coalesce(acted, F.lit(False))).alias("acted"))


def snk8_retired_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retired push, where nothing is ever confirmed empty."""
    s = adapter.stores(spark, sf_dir).select("dispensary_id", F.lit("2024-01-01").alias("last_fetched_at"), F.lit(False).alias("stale"))
    entries = q._read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dispensary_id"), (F.col("s_suppkey") % 3).alias("deal_count"), F.lit(False).alias("confirmed_empty"))
    return ingest.merged_stores(s, ingest.ingest_outcomes(s, entries), "2024-01-30")


def snk15_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = q._read(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("date"), "value")
    history = e.groupBy("date").agg(F.lit("old").alias("origin"), F.count("*").alias("n")).where("date < '2024-01-20'")
    derived = e.groupBy("date").agg(F.lit("new").alias("origin"), F.count_if(F.col("value") > 20).alias("n")).where("date >= '2024-01-15'")
    return ingest.upsert_by_date(history, derived)


def t1_feed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with live deals, stores with only expired ones, and stores with only drops."""
    deals = adapter.deals(spark, sf_dir)
    live = promotions.active_deals(promotions.usable_deals(deals), q.DAY, q.MINUTE).select("dispensary_id").distinct().withColumn("card", F.lit("live"))
    other = deals.select("dispensary_id").distinct().join(live, "dispensary_id", "left_anti").withColumn("card", F.lit("expired"))
    both = live.unionByName(other)
    drops = adapter.stores(spark, sf_dir).select("dispensary_id").join(both, "dispensary_id", "left_anti").withColumn("card", F.lit("drops"))
    return both.unionByName(drops)


def w7_store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.series(spark, sf_dir)
    return s.groupBy("dispensary_id").agg(F.countDistinct("day").alias("runs"), F.min("day").cast("string").alias("first_run"), F.max("day").cast("string").alias("last_run"))


def x6_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("event_id") % 7 == 0, "unreadable").otherwise(F.col("ts").cast("string"))
    seen = q._read(spark, sf_dir, "events").select("event_id", at.alias("seen_at"))
    return outreach.unexpired(seen, "2024-02-04 00:00:00", 20).select("event_id")


def x10_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = adapter.citations(spark, sf_dir).withColumn("run", F.to_date("checked_at").cast("string"))
    share = outreach.citation_share(daily)
    return share.select("run", F.format_string("%s: %d of %d questions cited, %d checks failed", "run", "cited_questions", "questions", "errors").alias("line"))


def f2_nested_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = serving.nested_stores(adapter.stores(spark, sf_dir).select("dispensary_id"), promotions.usable_deals(adapter.deals(spark, sf_dir)))
    active = serving.with_active_deals(documents, q.DAY, q.MINUTE)
    return active.select("dispensary_id", F.size("deals").alias("deals"), F.get("deals", F.lit(0))["deal_id"].alias("first_deal"))


def f8_normalized_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.stores(spark, sf_dir)
    far = F.when(F.col("balance") < 0, F.lit(float("nan"))).when(F.col("balance") < 5000, F.col("balance"))
    raw = s.select("dispensary_id", far.alias("distance_miles"), F.when(F.col("balance") < 7000, F.col("lat")).alias("lat"), "lng")
    out = serving.normalized_stores(raw)
    return out.select("dispensary_id", "distance_miles", fn.r4(F.col("lat")).alias("lat"), fn.r4(F.col("lng")).alias("lng"))


def f19_valid_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.own_median(adapter.series(spark, sf_dir), ["dispensary_id", "product_id"], q.EVENT_DAY)
    return serving.valid_drops(found).select("dispensary_id", "product_id", "pct_vs_median")


def s32_citation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = q._read(spark, sf_dir, "pages")
    answers = p.select(F.col("page_id").alias("answer_id"), F.when(F.col("page_id") % 2 == 0, "see Tallyloom today").otherwise("none").alias("text"), F.array("url", F.lit("https://www.last.example/x"), "url").alias("urls"))
    return serving.citation_hits(answers, "example.org", "tallyloom").select("answer_id", "cited", "named_only", F.size("hosts").alias("hosts"))


def s33_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.urgency_badges(adapter.deals(spark, sf_dir), q.MINUTE)


def js2_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    answer = F.when(F.col("event_id") % 5 == 0, "no json").otherwise(
        F.concat(F.lit('{"intent": '), (k % 9).cast("string"), F.lit(', "confidence": '), (k / 50).cast("string"), F.lit("}"))
    )
    return q._read(spark, sf_dir, "events").select("event_id", serving.classification(answer).alias("c")).select("event_id", "c.intent", fn.r4(F.col("c.confidence")).alias("confidence"))


def src50_listed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    one = F.concat(F.lit('{"item": {"text": "a", "value": "'), n, F.lit('"}}'))
    many = F.concat(F.lit('{"item": [{"text": "a", "value": "'), n, F.lit('"}, {"text": "b", "value": "7"}, {"text": "c", "value": "7"}]}'))
    answer = F.when(F.col("p_partkey") % 2 == 0, one).otherwise(many)
    return q._read(spark, sf_dir, "part").select("p_partkey", F.array_join(serving.listed_values(answer, "item"), ",").alias("listed"))


def x2_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = q._cells(spark, sf_dir)
    kind = F.when(F.col("stores") > 2, "disparity").otherwise("regional-floor")
    return c.select("match_key", "weight_grams", serving.headline(kind, F.col("display_name"), F.col("low_price"), F.col("high_price"), F.col("stores")).alias("headline"))


def r3_region_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = adapter.stores(spark, sf_dir).select("dispensary_id", F.when(F.col("balance") < 2000, "stale").otherwise("ok").alias("status"))
    return serving.region_caveats(regions.standing_floors(q._floors(spark, sf_dir, q._members(spark, sf_dir)), status))


def r7_site_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.site_entries(q.t5_sitemap(spark, sf_dir), "https://site.example/?a=1&b=")


QUERIES = {
    name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")
}
