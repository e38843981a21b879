"""The nightly run, tables kept by key, medians kept by increments, and places over a whole table."""

import datetime
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import facts, outreach, ranking, regions, series
from tallyloom.operators.tally import Tally
from tallyloom.plans import derivation, envelope, keyed
from tallyloom.plans.increments import OwnMedians

RECORD = "dispensary_id string, product_id string, name string, category string, brand string, flags array<string>, match_key string, weight_grams double, observed_at timestamp_ntz, base_price double, quantity_available double, special boolean, special_price double"
DAY = datetime.datetime(2026, 1, 30, 9)


def record(store, product, key="k", price=10.0, brand="Acme ", category="Flower", flags=(), grams=3.5, quantity=4.0):
    return (store, product, product.upper(), category, brand, list(flags), key, grams, DAY, price, quantity, False, None)


def a_run(spark, root, records, **more):
    seen = [("s1", "p1", d, d * 10, datetime.datetime(2026, 1, d), "Acme", d > 20, 10.0 + d) for d in range(15, 31)] + [("s1", "p2", 30, 999, DAY, None, False, None)]
    watched = spark.createDataFrame(seen, "dispensary_id string, product_id string, d int, obs_seq long, observed_at timestamp_ntz, brand string, special boolean, price double")
    places = spark.createDataFrame([("s1", 47.0, -122.0), ("s2", 47.01, -122.0), ("s3", None, None)], "dispensary_id string, lat double, lng double")
    deals = spark.createDataFrame([(1, "s1", "daily", "20% off entire store", 20, None, None, ["everyday"])], "deal_id long, dispensary_id string, type string, description string, discount_pct int, start_time string, end_time string, days_valid array<string>")
    inputs = {"places": places, "deals": deals, "record_day": "2026-01-30", "series_day": "2026-01-30"} | more
    return derivation.run_over(spark, root, spark.createDataFrame(records, RECORD), watched.withColumn("day", F.to_date("observed_at")), **inputs)


RECORDS = [
    record("s1", "a"), record("s2", "b", price=14.0), record("s3", "c", price=12.0), record("s1", "d", key=None), record("s1", "e", brand=None),
    record("s2", "f", category="Edible"), record("s2", "g", flags=["weight-mismatch"]), record("s2", "h", brand="ACME", quantity=0.0),
]


def told(manifest):
    return {r.fact: (r.outcome, r.fact_count, json.loads(r.counters or "{}"), r.error) for r in manifest.collect()}


def test_a_run_counts_what_it_leaves_out(spark, tmp_path):
    run = a_run(spark, str(tmp_path), RECORDS)
    found = told(derivation.derive(run, "2026-01-30"))
    assert {f: o for f, (o, *_) in found.items()} == dict.fromkeys(derivation.FACTS, "written")
    counters = {f: c for f, (_, _, c, _) in found.items()}
    assert counters["disparities"] == {"total_records": 8, "non_comparable_category": 1, "excluded_flag": 1, "unmatched": 1, "stale": 0, "disparities": 1}
    assert counters["brand_matrix"] == {"null_brand_products": 1, "unmatched_products": 1, "total_brands": 1, "multi_store_brands": 1}
    assert counters["brand_personas"]["null_brand_products"] == 1
    assert counters["own_median"]["no_usable_price"] == 1 and counters["own_median"]["total_series"] == 1
    assert counters["delivered"] == {"total_cells": 1, "store_offers": 3, "offers_with_place": 2, "missing_place": 1}
    assert counters["region_members"] == {"clustered_stores": 2, "unclustered_stores": 1, "members": 2}
    assert counters["region_floors"] == {"total_floors": 1, "single_store_floors": 0}
    assert counters["region_gaps"] == {"total_clusters": 1, "suppressed_clusters": 0}
    row = run.fact("brand_matrix").first()
    assert (row.display_brand, row.product_count, row.stores_carrying, row.tiers) == ("Acme", 7, ["s1", "s2", "s3"], [3.5])
    assert run.fact("brand_cells").first().cheapest_stores == ["s1"]
    assert derivation.manifests(spark, str(tmp_path)).count() == len(derivation.FACTS)
    kept = envelope.read_envelope(spark, f"{tmp_path}/region_floors").first()
    assert json.loads(kept["counters"]) == counters["region_floors"] and kept["fact_count"] == 1


def test_one_broken_fact_leaves_the_others(spark, tmp_path):
    def broken(run, tally):
        return run.records.select(F.raise_error(F.lit("torn")).alias("x"))

    facts = {k: derivation.FACTS[k] for k in ("disparities", "extraction_health", "special_events", "arrivals", "rollup_category")}
    assert {o for o, *_ in told(derivation.derive(a_run(spark, str(tmp_path), RECORDS), "2026-01-29", facts)).values()} == {"written"}
    before = envelope.read_envelope(spark, f"{tmp_path}/extraction_health").first()
    found = told(derivation.derive(a_run(spark, str(tmp_path), RECORDS), "2026-01-30", facts | {"extraction_health": broken}))
    assert found["extraction_health"][0] == "failed" and "torn" in found["extraction_health"][3]
    assert found["arrivals"][0] == "failed" and "extraction_health" in found["arrivals"][3]  # it needs the broken one
    assert {found[k][0] for k in ("disparities", "special_events", "rollup_category")} == {"written"}
    assert envelope.read_envelope(spark, f"{tmp_path}/extraction_health").first() == before


def test_no_records_stop_a_run(spark, tmp_path):
    facts = {"disparities": derivation.disparities}
    derivation.derive(a_run(spark, str(tmp_path), RECORDS), "2026-01-29", facts)
    with pytest.raises(ValueError, match="no records"):
        derivation.derive(a_run(spark, str(tmp_path), []), "2026-01-30", facts)
    assert envelope.read_count(spark, f"{tmp_path}/disparities") == 1


def test_inputs_are_scanned_once(spark, tmp_path):
    """Both inputs are staged when the run is made; no fact's plan names another source of records or series."""
    run = a_run(spark, str(tmp_path), RECORDS)
    for name, make in derivation.FACTS.items():
        try:
            plan = make(run, Tally())._jdf.queryExecution().optimizedPlan().toString()
        except derivation.MissingFact:
            continue
        if name != "deal_scope":
            assert "LocalRelation" not in plan.replace("LocalRelation [dispensary_id", "").replace("LocalRelation <empty>", ""), name


def test_tally_counts_in_the_pass(spark):
    tally = Tally()
    rows = tally.on(spark.range(10), total=F.count("*"), even=F.count_if(F.col("id") % 2 == 0)).where("id > 7")
    assert rows.count() == 2 and tally.counts() == {"total": 10, "even": 5}


def in_threads(n, work):
    failed = []

    def guarded(k):
        try:
            work(k)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=guarded, args=(k,)) for k in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed, failed


def test_writers_at_once_lose_no_version(spark, tmp_path):
    path = str(tmp_path / "fact")
    counters = spark.createDataFrame([(1,)], "total int")
    in_threads(3, lambda k: [envelope.write_fact(spark.createDataFrame([(k,)], "x int"), counters, path, f"{k}-{j}") for j in range(2)])
    numbers = [r.number for r in envelope.envelopes(spark, path).collect()]
    assert sorted(numbers) == list(range(1, 7))
    assert envelope.read_facts(spark, path, "x int").count() == 1


TABLE = "k long, v string, seen array<int>, first int"


def batch(spark, rows):
    return spark.createDataFrame(rows, TABLE)


MERGE = {"seen": keyed.appended, "first": keyed.earlier}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], TABLE, buckets=32)
    assert table.read().count() == 0 and table.get(1).count() == 0
    table.upsert(batch(spark, [(k, "a", [0], 5) for k in range(400)] + [(None, "x", [1], 1)]))
    before = table.manifest()[1]
    touched = table.upsert(batch(spark, [(k, "b", [k], 3 + k) for k in (1, 5, 9, 1000)]), MERGE)
    after = table.manifest()[1]
    assert len(touched) <= 4 and {b for b in after if after[b] != before.get(b)} == set(touched)
    rows = {r.k: (r.v, r.seen, r.first) for r in table.read().collect()}
    assert len(rows) == 401 and rows[5] == ("b", [0, 5], 5) and rows[1] == ("b", [0, 1], 4) and rows[1000] == ("b", [1000], 1003) and rows[2] == ("a", [0], 5)
    again = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], TABLE, buckets=7)  # another session: the layout is the table's
    assert again.buckets == 32
    one = again.get(9)
    assert [r.v for r in one.collect()] == ["b"]
    assert len(one.inputFiles()) == 1
    wanted = spark.createDataFrame([(1,), (1,), (399,), (5000,)], "k long")
    assert sorted(r.k for r in again.lookup(wanted).collect()) == [1, 399]


def test_upserts_at_once_lose_nothing(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], TABLE, buckets=2)
    in_threads(3, lambda w: [table.upsert(batch(spark, [(k, f"w{w}", [w * 10 + j], w) for k in range(6)]), MERGE) for j in range(2)])
    rows = table.read().collect()
    assert len(rows) == 6 and all(sorted(r.seen) == [0, 1, 10, 11, 20, 21] and r.first == 0 for r in rows)


def test_medians_by_increments_equal_the_whole(spark, tmp_path):
    rng = random.Random(4)
    first = datetime.date(2026, 1, 1)
    rows = []
    for p in range(12):
        for d in range(50):
            if rng.random() < (0.5 if p % 3 else 0.15) and not (p == 5 and d > 12):
                at = datetime.datetime.combine(first, datetime.time(rng.randrange(24))) + datetime.timedelta(d)
                rows.append((f"s{p % 2}", f"p{p}", len(rows), at, "b", False, rng.choice([None, 0.0, 5.0, 6.0, 7.5]), at.date()))
    seen = spark.createDataFrame(rows, "dispensary_id string, product_id string, obs_seq long, observed_at timestamp_ntz, brand string, special boolean, price double, day date").cache()
    kept = OwnMedians(spark, str(tmp_path), buckets=4)
    day = lambda k: first + datetime.timedelta(k)
    kept.load(seen, day(36))
    last = 36
    for k in (37, 38, 42):  # no run saw the days between
        usable = seen.where((F.col("day") <= F.lit(day(last))) | (F.col("day") == F.lit(day(k))))
        touched = kept.advance(usable, day(k), day(last)).count()
        whole = series.own_median(seen.where((F.col("day") <= F.lit(day(k))) & ~F.col("day").isin([day(j) for j in range(39, 42)])), ["dispensary_id", "product_id"], str(day(k)))
        columns = ["dispensary_id", "product_id", "outcome", "current_price", "median_price", "pct_vs_median", "observed_days"]
        assert sorted(map(repr, kept.read().select(columns).collect())) == sorted(map(repr, whole.select(columns).collect())), k
        assert touched <= 12
        last = k


def test_places_over_a_whole_table(spark):
    rng = random.Random(8)
    values = [(rng.randrange(50), k) for k in range(3000)]
    rows = spark.createDataFrame(values, "a int, b int").repartition(7)
    got = ranking.ranked(rows, F.desc("a"), "b", name="place").collect()
    order = sorted(values, key=lambda v: (-v[0], v[1]))
    assert sorted((r.place, (r.a, r.b)) for r in got) == list(enumerate(order, 1))
    assert ranking.ranked(rows.where("false"), "a").count() == 0


def brute_clusters(places, radius):
    from math import asin, cos, radians, sin, sqrt

    def miles(p, q):
        a, b, c, d = map(radians, (p[1], p[2], q[1], q[2]))
        return 2 * 3958.8 * asin(min(1.0, sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2)))

    low = {p[0]: p[0] for p in places}
    changed = True
    pairs = [(p[0], q[0]) for k, p in enumerate(places) for q in places[:k] if miles(p, q) <= radius]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("seed,spread,lat", [(1, 3.0, 47.0), (2, 0.6, 47.0), (3, 2.0, 0.0), (4, 4.0, 66.0)])
def test_clusters_equal_brute_force(spark, seed, spread, lat):
    rng = random.Random(seed)
    places = [(f"s{k:03}", lat + rng.uniform(-spread, spread), -122 + rng.uniform(-spread, spread)) for k in range(220)]
    places += [(f"t{k:03}", lat + 0.001 * k, -100.0) for k in range(60)]
    rows = spark.createDataFrame([*places, ("none", None, 1.0), ("nan", float("nan"), 1.0)], "dispensary_id string, lat double, lng double")
    got = {r.dispensary_id: r.cluster_id for r in regions.clusters(rows).collect()}
    assert got == brute_clusters(places, regions.RADIUS_MILES)


def test_a_dense_city_makes_no_pairs(spark):
    """100,000 stores in one city are one cluster through a handful of cells; a far store is its own."""
    city = spark.range(100_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("dispensary_id"), (47.0 + F.rand(3) * 0.5).alias("lat"), (-122.0 + F.rand(4) * 0.5).alias("lng"))
    far = spark.createDataFrame([("x", 49.0, -122.0)], "dispensary_id string, lat double, lng double")
    found = regions.clusters(city.unionByName(far)).groupBy("cluster_id").count().collect()
    assert {(r.cluster_id, r["count"]) for r in found} == {("c000000", 100_000), ("x", 1)}


def test_phrases_of_a_table(spark):
    posts = spark.createDataFrame([(1, "In Kent, WA: cheap 1/8 oz!"), (2, "kentish cheap"), (3, None), (4, "la la land kent")], "id int, text string")
    many = [(f"filler {k}",) for k in range(10_000)]
    phrases = spark.createDataFrame([("Kent",), ("kent wa",), ("cheap 1 8",), ("la la",), ("",), (None,), ("!!",), ("kent",), *many], "phrase string")
    got = sorted((r.id, r.phrase) for r in outreach.phrase_hits(posts, phrases).collect())
    assert got == [(1, "Kent"), (1, "cheap 1 8"), (1, "kent"), (1, "kent wa"), (4, "Kent"), (4, "kent"), (4, "la la")]
    plan = outreach.phrase_hits(posts, phrases)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "filler" not in plan
    assert outreach.phrase_hits(posts, phrases.where("false")).count() == 0


def test_mentions_get_the_fact_that_answers_them(spark):
    names = spark.createDataFrame([("slug", "kent", "kent", "s1"), ("name", "kent", "kent", "s1")], "by string, name string, region string, cluster_id string")
    floors = spark.createDataFrame([("kent", "Flower", "Blue Dream", 3.5, 20.0, False)], "region string, category string, display_name string, weight_grams double, floor_price double, stale boolean")
    gaps = spark.createDataFrame([("Edible", "Wyld Gummy", 1.0, 5.0, 9.0, 0.8, [("s1", 5.0), ("s2", 9.0)])], "category string, display_name string, weight_grams double, low_price double, high_price double, spread_pct double, stores_carrying array<struct<dispensary_id:string,price:double>>")
    drops = spark.createDataFrame([], "dispensary_id string, region string, category string, name string, current_price double, median_price double, pct_vs_median double")
    posts = [(1, "flower", "Kent", 1, "wyld"), (2, "flower", "Kent", 2, "wyld"), (3, "flower", "Kent", 2, "Blue dream!"), (4, "flower", "Kent", 6, ""), (5, "edibles", "WA", 6, "wyld"), (6, "flower", "Boise, ID", 1, None), (7, "x", "", 0, ""), (8, None, None, None, None)]
    rows = spark.createDataFrame(posts, "post_id int, topic string, place string, intent int, brand string")
    dated = spark.createDataFrame([("regional-floor", "2026-01-30 04:00:00"), ("disparity", "2025-11-01 04:00:00")], "kind string, as_of string")
    found = facts.mention_candidates(rows, dated, "2026-01-30 12:00:00", floors=floors, gaps=gaps, drops=drops, names=names)
    got = {r.post_id: (r.fact, r.freshness) for r in found.collect()}
    assert got == {1: ("regional-floor", "fresh"), 2: (None, ""), 3: ("regional-floor", "fresh"), 4: ("regional-floor", "fresh"), 5: ("disparity", "stale"), 6: (None, "")}


def test_worklist_as_a_page(spark):
    pairs = spark.createDataFrame(
        [("http://b", " ", "2026-01-02", "reddit", "disparity", "Flower", 20.0, 210.5), ("http://a", "Where to buy", "unknown", "forum", "own-median", None, 8.5, 300.0)],
        "url string, title string, posted string, channel string, kind string, category string, price double, fit_score double",
    )
    counters = facts.worklist_counters(spark.range(7), pairs)
    lines = [r.line for r in facts.worklist_lines(facts.worklist(pairs), counters, "2026-01-30").orderBy("n").collect()]
    assert lines[:4] == ["# Worklist", "", "Generated 2026-01-30. Scanned 7, kept 2.", ""]
    assert lines[4] == "" or lines[4].startswith("## 1.")
    page = "\n".join(lines)
    assert "## 1. Where to buy\n- Thread: http://a\n- Channel: forum\n- Fact: own-median at $8.50\n" in page
    assert "## 2. http://b\n- Thread: http://b (2026-01-02)\n- Channel: reddit\n- Fact: disparity in Flower at $20" in page
    none = facts.worklist_lines(pairs.where("false"), facts.worklist_counters(spark.range(0), pairs.where("false")), "2026-01-30").collect()
    assert [r.line for r in sorted(none, key=lambda r: r.n)][3] == "Nothing to act on: no candidates."
