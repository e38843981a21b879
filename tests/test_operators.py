"""Gates, gaps, ties and other cases that the test tables do not hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import brands, disparity, facts, freshness, ingest, outreach, promotions, regions, series, serving
from tallyloom.operators.graph import components
from tallyloom.operators.tally import Tally
from tallyloom.plans import envelope
from tallyloom.sources import payloads

SF = "/root/testdata/sf0.001"

RECORD = (
    "dispensary_id string, product_id string, name string, category string, brand string, strain_type string, subcategory string, flags array<string>,"
    " option string, observed_at timestamp_ntz, base_price double, special_price double, quantity_available double"
)
DAY = datetime.datetime(2026, 7, 1, 12)


def record(store, product="p", name="Blue Dream", category="Flower", brand="Acme", flags=(), option="3.5g", at=DAY, base=30.0, special=None, stock=None):
    return (store, product, name, category, brand, None, None, list(flags), option, at, base, special, stock)


def cells(spark, rows, **options):
    gated = disparity.gated(spark.createDataFrame(rows, RECORD), "2026-07-02", **options)
    return gated, disparity.disparities(disparity.store_offers(disparity.offers(gated)))


def test_gates_in_order(spark):
    rows = [
        record("a"), record("b", base=20.0, option="1/8oz"),
        record("c", category="Edible", flags=["weight-mismatch"]),
        record("d", flags=["weight-mismatch"], at=DAY - datetime.timedelta(days=9)),
        record("e", name="", brand=None, at=DAY - datetime.timedelta(days=9)),
        record("f", at=DAY - datetime.timedelta(days=9)),
        record("g", at=None),
        record("h", at=DAY + datetime.timedelta(days=400), stock=0.0),
        record("i", stock=0.0), record("j", base=None), record("k", special=0.0), record("l", base=float("nan")), record("m", flags=["assumed-single"], base=25.0),
    ]
    gated, found = cells(spark, rows)
    reasons = {r.dispensary_id: r.reason for r in gated.collect()}
    assert [reasons[c] for c in "abcdefghijklm"] == [None, None, "non-comparable-category", "excluded-flag", "unmatched", "stale", "stale", None, None, None, None, None, None]
    (cell,) = found.collect()
    assert (cell.low_price, cell.high_price, cell.spread, cell.spread_pct, cell.stores) == (20.0, 30.0, 10.0, 0.5, 3)
    assert [s.dispensary_id for s in cell.stores_carrying] == ["b", "m", "a"]
    counts = disparity.gate_counters(gated, disparity.offers(gated)).first()
    assert (counts.total_records, counts.stale_records, counts.unmatched_count, counts.excluded_flag_count, counts.non_comparable_category_count, counts.placed_records) == (13, 2, 1, 1, 1, 3)


def test_price_ties_and_one_store(spark):
    _, found = cells(spark, [record("b"), record("a"), record("a", product="q", base=31.0)])
    cell = found.first()
    assert cell.spread == 0.0 and cell.stores == 2
    ends = disparity.endpoints(found).first()
    assert ends.low_store is None and ends.high_store is None
    assert disparity.top_gaps(found).count() == 0
    assert cells(spark, [record("a"), record("a", product="q")])[1].count() == 0
    assert cells(spark, [])[1].count() == 0


@pytest.mark.parametrize(("value", "want"), [(None, 1), (2.9, 2), (-3, 0), (float("nan"), 1), (float("inf"), 1)])
def test_lag(value, want):
    assert disparity.lag_days(value) == want


def test_explicit_anchor(spark):
    rows = [record("a", at=DAY - datetime.timedelta(days=30)), record("b", at=DAY - datetime.timedelta(days=30)), record("c")]
    assert cells(spark, rows, anchor="2026-06-01")[1].count() == 1
    assert cells(spark, rows, anchor="2026-02-31")[1].count() == 0


def daily(spark, rows):
    return spark.createDataFrame(rows, "k string, day string, value boolean").withColumn("day", F.col("day").cast("date"))


def test_walk(spark):
    d = daily(spark, [("a", "2026-01-01", True), ("a", "2026-01-03", True), ("a", "2026-01-04", False)])
    assert [r.status for r in series.day_walk(d, ["k"]).orderBy("day").collect()] == ["first", "gap", "unchanged", "changed"]
    got = series.day_walk(d, ["k"], "2026-01-02", "2026-01-05").orderBy("day").collect()
    assert [r.status for r in got] == ["gap", "first", "changed", "gap"] and got[2].previous is True
    assert series.day_walk(daily(spark, []), ["k"]).count() == 0
    with pytest.raises(ValueError):
        series.day_walk(d, ["k"], "2026-01-03", "2026-01-02")


def test_sessions(spark):
    rows = [(1, "e", "2026-01-01 00:00:00"), (2, "e", "2026-01-01 00:00:02"), (3, "e", "2026-01-08 00:00:00"), (4, "e", None), (5, "e", None)]
    df = spark.createDataFrame(rows, "id int, e string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.id: r.run for r in series.sessions(df, ["e"], "ts", ["id"]).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4], got[5]}) == 4


def test_clusters_chain(spark):
    places = spark.createDataFrame([("a", 47.0, -122.0), ("b", 47.1, -122.0), ("c", 47.2, -122.0), ("d", 48.9, -122.0), ("e", None, -122.0)], "dispensary_id string, lat double, lng double")
    got = {r.dispensary_id: r.cluster_id for r in regions.clusters(places).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_pairs_need_no_cross_join(spark):
    places = spark.createDataFrame([("a", 47.0, -122.0)], "dispensary_id string, lat double, lng double")
    plan = regions.pairs_within(places)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_standing_floors(spark):
    f = spark.createDataFrame([("c", "k", 1.0, "n", "Flower", 5.0, ["a", "b"], 2), ("c", "m", 1.0, "n", "Flower", 5.0, ["b"], 2)],
                              "cluster_id string, match_key string, weight_grams double, display_name string, category string, floor_price double, floor_stores array<string>, store_count_in_cluster long")
    status = spark.createDataFrame([("b", "stale")], "dispensary_id string, status string")
    got = {r.match_key: (r.floor_stores, r.stale) for r in regions.standing_floors(f, status).collect()}
    assert got == {"k": (["a"], False), "m": (["b"], True)}


def test_personas(spark):
    days = spark.createDataFrame([("s", p, k, p == "x" or (p == "y" and k == 0)) for p in "xyz" for k in range(12)] + [("s", "w", 0, True)], "dispensary_id string, product_id string, day int, special boolean")
    products = spark.createDataFrame([("s", "x", "A"), ("s", "y", "B"), ("s", "z", "C!"), ("s", "w", "D"), ("s", "v", "a "), ("s", "u", None)], "dispensary_id string, product_id string, brand string")
    got = {r.brand_key: r for r in brands.personas(days, products).collect()}
    assert {k: r.persona for k, r in got.items()} == {"a": "always-on-special", "b": "intermittently-discounted", "c": "never-discounted", "d": "insufficient-history"}
    assert got["a"].product_count == 2 and got["a"].display_brand == "A" and got["d"].special_day_fraction is None


def test_freshness(spark):
    times = ["2026-01-01 11:00:00", "2026-01-01 05:00:00", "2025-12-29 00:00:00", "bad", None, "2026-01-02 00:00:00", "2015-01-01 00:00:00"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, last_fetched_at string")
    at, now = F.col("last_fetched_at"), "2026-01-01 12:00:00"
    got = df.select("k", freshness.store_status(at, now).alias("s"), freshness.run_freshness(at, now).alias("r"), freshness.deals_expired(at, now).alias("x")).orderBy("k").collect()
    assert [r.s for r in got] == ["ok", "stale", "stale", "failed", "failed", "ok", "stale"]
    assert [r.r for r in got] == ["fresh", "fresh", "stale", "never-derived", "never-derived", "future-skew", "never-derived"]
    assert [r.x for r in got] == [False, False, True, True, True, False, True]
    one = freshness.alert(df, now).first()
    assert (one.fresh_count, one.stale_count, one.total_failure, one.alert) == (2, 2, False, True)


def test_append_keeps_identity(spark):
    keys = ["product_key"]
    products = spark.createDataFrame([("a", "old"), ("b", "old")], "product_key string, name string")
    existing = spark.createDataFrame([("a", "t1")], "product_key string, observed_at string")
    incoming = spark.createDataFrame([("a", "t1", 1, "dup"), ("b", "t1", 2, "new"), ("b", "t1", 3, "dup"), ("c", "t1", 4, "c")], "product_key string, observed_at string, obs_seq int, name string")
    fresh = ingest.new_observations(existing, incoming, ["product_key", "observed_at"])
    assert sorted(r.obs_seq for r in fresh.collect()) == [2, 4]
    got = {r.product_key: r.name for r in ingest.refreshed_identity(products, fresh, keys, ["name"]).collect()}
    assert got == {"a": "old", "b": "new", "c": "c"}


def test_confirmed_empty_and_reference(spark):
    a = spark.createDataFrame([("a", True, True, 0), ("a", True, True, 0), ("b", True, True, 0), ("b", False, True, 0), ("c", True, False, 0)], "dispensary_id string, ok boolean, captured boolean, cards int")
    assert {r.dispensary_id: r.confirmed_empty for r in ingest.confirmed_empty(a).collect()} == {"a": True, "b": False, "c": False}
    old = spark.createDataFrame([("gas", 4.5)], "k string, v double")
    new = spark.createDataFrame([("gas", 0.0)], "k string, v double")
    assert ingest.kept_reference(old, new, "k", "v").first().v == 4.5


def test_normalize(spark):
    o = "array<struct<option:string,base_price:double,special_price:double,quantity_available:double>>"
    rows = [
        ("PR 2pk", "Pre-Rolls", 500.0, 1000.0, [("1g", 10.0, None, 1.0)]), ("PR", "Pre-Rolls", 700.0, 1000.0, [("1g", 10.0, 8.0, 1.0)]),
        ("F 2pk", "Flower", None, None, [("1g", 10.0, None, 1.0), ("x", 9.0, None, 1.0)]), ("E", "Edible", None, None, [("100mg", 10.0, None, 1.0)]),
    ]
    got = ingest.normalize_products(spark.createDataFrame(rows, f"name string, category string, weight_field double, net_weight_mg double, options {o}")).collect()
    assert [r.flags for r in got] == [[], ["assumed-single", "weight-mismatch"], ["unparseable-weight", "unreconciled-pack"], []]
    assert got[0].options[0].price_per_item == 5.0 and got[0].options[0].price_per_gram == 10.0
    assert got[1].options[0].special_price_per_gram == 8.0 and got[3].options[0].price_per_gram is None and got[2].pack_count == 2


def test_alerts_and_seen(spark):
    c = spark.createDataFrame([("a", 1, 1, 0.9, "f"), ("a", 2, 1, 0.9, "f"), ("b", 3, 0, 0.9, "f"), ("c", 4, 2, 0.6, "f"), ("d", 5, 2, 0.7, None), ("e", 6, 6, 0.7, "f")], "post_id string, position int, intent int, confidence double, fact string")
    seen = spark.createDataFrame([("e", "2026-01-01"), ("z", "bad"), ("y", "2024-01-01")], "post_id string, seen_at string")
    assert [(r.post_id, r.position) for r in outreach.alerts(c, seen).collect()] == [("a", 1)]
    assert {r.post_id for r in outreach.unexpired(seen, "2026-06-01 00:00:00").collect()} == {"e", "z"}


def test_envelope_guard(spark, tmp_path):
    path = str(tmp_path / "fact")
    facts = spark.createDataFrame([(1,)], "x int")
    counters = spark.createDataFrame([(5, 2)], "total int, stale int")
    assert envelope.read_envelope(spark, path).first().generated_at == envelope.EPOCH
    assert envelope.write_fact(facts, counters, path, "2026-01-01T00:00:00Z")
    assert envelope.read_count(spark, path) == 1
    assert not envelope.write_fact(facts.where("x = 9"), counters, path, "2026-01-02T00:00:00Z")
    assert envelope.read_envelope(spark, path).first().generated_at == "2026-01-01T00:00:00Z"
    for day in (2, 3, 4):
        assert envelope.write_fact(spark.createDataFrame([(day,)], "x int"), counters, path, f"2026-01-0{day}T00:00:00Z")
        assert [r.x for r in envelope.read_facts(spark, path, "x int").collect()] == [day]
    (tmp_path / "fact" / "facts" / "torn").mkdir()  # a write that stopped before its envelope
    assert [r.x for r in envelope.read_facts(spark, path, "x int").collect()] == [4]
    assert len([f for f in (tmp_path / "fact" / "facts").iterdir() if f.name != "torn"]) == 2


def test_product_pages(spark):
    body = """{"data":{"filteredProducts":{"products":[{"_id":"1","Name":" Blue  Dream ","type":"Flower","special":true,"Options":["1g","2g"],"recSpecialPrices":[8.0],
      "POSMetaData":{"children":[{"option":"1g","price":9.0,"quantityAvailable":0},{"option":"1g","price":10.0,"quantityAvailable":3}]},
      "THCContent":{"unit":" % ","range":[20.0,18.0]},"CBDContent":{"unit":"%","range":[-1.0]},"effects":{"a":1.0},"measurements":{"netWeight":{"unit":"GRAMS","values":[1.0]}}},
      {"id":"2","Name":"x","type":"Other","Options":["1g"]},{"Name":"no id"}]}}}"""
    pages = spark.createDataFrame([("u/FilteredProducts", 2, body), ("u/filteredproducts", 1, body.replace("Blue", "Green")), ("u/other", 0, body), ("u/FilteredProducts", 3, "not json")], "url string, page_seq int, body string")
    got = payloads.raw_products(payloads.product_pages(pages), ["Flower"]).collect()
    (r,) = got
    assert r.name == "Green Dream" and [(o.base_price, o.special_price, o.quantity_available) for o in r.options] == [(10.0, 8.0, 3.0), (None, None, None)]
    assert (r.thc.unit, r.thc.low, r.thc.high) == ("%", 18.0, 20.0) and r.cbd is None and r.net_weight_mg == 1000.0 and r.effects == {"a": 1.0}


def test_menu_items(spark):
    html = """<script id="__NEXT_DATA__" type="application/json">{"props":{"dehydratedState":{"queries":[{"state":{"data":{"data":{"menuItems":[
      {"slug":"good-farms-cart-x","name":"Blue | 1g","edgeCategory":{"name":"Vape","slug":"cart","ancestors":[{"name":"All","slug":"all"}]},
       "prices":{"gram":[{"label":"1g","price":20.0,"originalPrice":25.0,"onSale":true},{"label":"1g","price":1.0}]}},
      {"slug":"z","name":"n","edgeCategory":{"name":"Gear","slug":"gear"},"prices":{}}]}}}},{"state":{"data":{"menuItems":[{"slug":"good-farms-cart-x","name":"dup"}]}}}]}}}</script>"""
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_seq int, html string")
    (r,) = payloads.menu_products(payloads.menu_items(pages)).collect()
    assert (r.name, r.category, r.brand, r.special) == ("Blue", "Vaporizers", "Good Farms", True)
    assert [(o.option, o.base_price, o.special_price) for o in r.options] == [("1g", 25.0, 20.0)]


def test_cards_and_feeds(spark):
    html = '<li class="el-item"><h3>Monday &amp; Friday</h3><p>7-8am 20% OFF all</p></li><li class="el-item">no deal</li>'
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    (d,) = payloads.card_deals(pages, r"(?s)<li class=\"el-item\">.*?</li>").collect()
    assert (d.type, d.discount_pct, d.start_time, d.end_time, d.days_valid) == ("happy_hour", 20, "07:00", "08:00", ["monday", "friday"])
    listing = spark.createDataFrame([('{"data":{"children":[{"data":{"id":"a","title":"t"}},{"data":{"title":"x"}}]}}',)], "body string")
    assert [(r.id, r.selftext) for r in payloads.feed_posts(listing).collect()] == [("a", "")]
    rss = spark.createDataFrame([("<feed><entry><id>t3_ab1</id><title>A &amp;amp; b</title><content>&lt;p&gt;hi&lt;/p&gt;</content></entry><entry><id>t1_x</id></entry></feed>",)], "body string")
    assert [(r.id, r.title, r.text) for r in payloads.feed_entries(rss).collect()] == [("ab1", "A & b", "hi")]
    lines = spark.createDataFrame([('"www.A.com",3',), ("x;https://b.org/p",), ("none",)], "value string")
    assert {r.domain for r in payloads.first_domains(lines).collect()} == {"a.com", "b.org"}
    log = spark.createDataFrame([('{"a":"1","b":2}',), ("",), ("{bad",), ('{"b":2}',)], "value string")
    rows, counts = payloads.log_rows(log, "a:string,b:int", ["a"])
    assert [(r.a, r.b) for r in rows.collect()] == [("1", 2)] and tuple(counts.first()) == (3, 1, 1)


def test_missing_document_is_empty(spark, tmp_path):
    assert payloads.read_json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_import_once(spark, tmp_path):
    from tallyloom.operators import serving

    target = str(tmp_path / "products")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert serving.import_once(spark, rows, ["k"], target) == 2
    with pytest.raises(ValueError, match="already"):
        serving.import_once(spark, rows, ["k"], target)
    with pytest.raises(ValueError, match="repeated"):
        serving.import_once(spark, rows.unionByName(rows), ["k"], target, force=True)
    assert serving.import_once(spark, rows.limit(1), ["k"], target, force=True) == 1


def test_stated_percent_and_zip(spark):
    df = spark.createDataFrame([("$5 grams", "10% off"), ("20% off $5", "20% off"), ("x", "none")], "n string, t string")
    assert [r[0] for r in df.select(payloads.stated_percent(F.col("n"), F.col("t"))).collect()] == [None, 20, None]
    z = spark.createDataFrame([(" 98201-1234 ",), ("9820",)], "z string")
    assert [r[0] for r in z.select(payloads.zip_key(F.col("z"))).collect()] == ["98201", None]


def test_stores_with_drops_alone_get_a_card(spark):
    deals = spark.createDataFrame([("a",), ("a",), ("b",)], "dispensary_id string")
    drops = spark.createDataFrame([("b",), ("c",), ("c",)], "dispensary_id string")
    assert sorted(tuple(r) for r in serving.carded_stores(deals, drops).collect()) == [("a", "deals"), ("b", "deals"), ("c", "drops")]


def test_histories_leave_orphans_out(spark):
    seen = spark.createDataFrame([("s", 1, 30), ("s", 1, 10), ("t", 1, 20), ("s", 9, 5), ("s", None, 6)], "store string, product int, seq int")
    known = spark.createDataFrame([(1, "one"), (2, "two")], "product int, name string")
    got = sorted((r.store, r.seq, r.position, r.name) for r in ingest.histories(seen, known, ["store", "product"], "seq", "product").collect())
    assert got == [("s", 10, 1, "one"), ("s", 30, 2, "one"), ("t", 20, 1, "one")]


def test_scopes_cover_the_linkable_categories(spark):
    """Concentrates and edibles are in no deal, not even the whole store's; flagged goods only where no weight is asked."""
    goods = [("p1", "Flower", 3.5, 10.0, []), ("p2", "Flower", 3.5, 10.0, ["weight-mismatch"]), ("p3", "Concentrate", 1.0, 10.0, []), ("p4", "Edible", None, 10.0, []), ("p5", "Pre-Rolls", 1.0, 0.0, []), ("p6", "Vaporizers", 1.0, 5.0, None)]
    records = spark.createDataFrame([("s", *g, None) for g in goods], "dispensary_id string, product_id string, category string, weight_grams double, base_price double, flags array<string>, special_price double")
    deals = spark.createDataFrame([(1, "s", "20% off entire store"), (2, "s", "eighth of flower"), (3, "s", "flower deal"), (4, "s", "gummies half off"), (5, "t", "everything")], "deal_id int, dispensary_id string, description string")
    got = {}
    for r in promotions.scope_products(deals, records).collect():
        got.setdefault((r.kind, r.category, r.weight_grams), set()).add(r.product_id)
    assert got == {("storewide", None, None): {"p1", "p2", "p6"}, ("category", "Flower", 3.5): {"p1"}, ("category", "Flower", None): {"p1", "p2"}}
    assert {r.deal_id: r.linked for r in promotions.deal_links(deals, records).collect()} == {1: 3, 2: 1, 3: 2, 4: 0, 5: 0}
    assert {r.deal_id: r.targeted for r in promotions.scoped_deals(deals).collect()} == {1: None, 2: None, 3: None, 4: "gummies", 5: None}


def test_facts_by_place_topic_and_kind(spark):
    floors = spark.createDataFrame([("city-a", "Flower", "x", 3.5, 10.0, True), ("city-a", "Flower", "y", 3.5, 12.0, False), ("city-b", "Edible", "z", None, 5.0, False)], "region string, category string, display_name string, weight_grams double, floor_price double, stale boolean")
    two = [("s1", 20.0, None), ("s2", 30.0, None)]
    gaps = spark.createDataFrame([("Flower", "g", 3.5, 20.0, 30.0, 0.5, two), ("Concentrate", "even", 1.0, 20.0, 20.0, 0.0, two)], "category string, display_name string, weight_grams double, low_price double, high_price double, spread_pct double, stores_carrying array<struct<dispensary_id:string,price:double,quantity_available:double>>")
    drops = spark.createDataFrame([("s1", "city-a", "Concentrate", "wax", 8.0, 10.0, -0.2), ("s9", None, "Concentrate", "rosin", 5.0, 10.0, -0.5), ("s1", "city-a", "Edible", "gum", 9.99, 10.0, -0.001)], "dispensary_id string, region string, category string, name string, current_price double, median_price double, pct_vs_median double")
    names = spark.createDataFrame([("slug", "city-a", "city-a", "s1"), ("name", "city a", "city-a", "s1"), ("name", "old town", "city-a", "s1"), ("slug", "city-b", "city-b", "s5")], "by string, name string, region string, cluster_id string")
    asks = [("flower", "Old Town"), ("flower", "wa"), ("dabs", "city a"), ("dabs", None), ("gummies", "City-A"), ("gummies", "city b"), ("flower", "Boise"), ("flower", "Atlantis"), (None, "city-a")]
    got = {(r.topic, r.place): (r.kind, r.name, r.reason) for r in facts.select_facts(spark.createDataFrame(asks + asks[:2], "topic string, place string"), floors, gaps, drops, names).collect()}
    assert got == {
        ("flower", "Old Town"): ("regional-floor", "y", None), ("flower", "wa"): ("disparity", "g", None), ("dabs", "city a"): ("own-median", "wax", None), ("dabs", ""): ("own-median", "rosin", None),
        ("gummies", "City-A"): ("none", None, "no fact"), ("gummies", "city b"): ("regional-floor", "z", None), ("flower", "Boise"): ("none", None, "outside the state"),
        ("flower", "Atlantis"): ("none", None, "unknown place"), ("", "city-a"): ("regional-floor", "y", None),
    }
    loose = facts.select_facts(spark.createDataFrame([("flower", "Atlantis")], "topic string, place string"), floors, gaps, drops, names, refuse=False)
    assert [(r.kind, r.reason) for r in loose.collect()] == [("disparity", None)]
    people = [("http://a.com/1", "seen in Old Town", None), ("http://a.com/2", "seen in Old Town, Oregon", None), ("http://a.com/3", "kentucky or bust", None), ("http://a.com/4", "x", "Boise"), ("http://a.com/5", None, "statewide"), ("nolink", "kent", "wa")]
    told = spark.createDataFrame([(u, t, None, "flower", g, None) for u, t, g in people], "url string, title string, snippet string, topic string, geo string, posted string")
    rivals = spark.createDataFrame([("b.com",)], "domain string")
    pairs = facts.paired(told, floors, gaps, drops, names, rivals, "2026-01-01 00:00:00")
    assert {(r.url, r.kind, r.fit_score) for r in pairs.collect()} == {("http://a.com/1", "disparity", 300.0), ("http://a.com/5", "disparity", 300.0)}
    assert tuple(facts.worklist_counters(told, pairs).first()) == (6, 2, None)
    assert tuple(facts.worklist_counters(told.where("false"), pairs.where("false")).first()) == (0, 0, "no candidates")
    assert [r[0] for r in spark.createDataFrame([("Acme Blue 1g", "blue"), ("Bluebird", "blue"), ("x", "")], "n string, b string").select(facts.concerns_brand(F.col("n"), F.col("b"))).collect()] == [True, False, False]


DEAL = "deal_id long, dispensary_id string, type string, description string, discount_pct int, start_time string, end_time string, days_valid array<string>"
SAID = [None, "", "10% off vape carts", "entire store", "10% off <b>vape</b>", None, "10% off vape carts"]


def deals_saying(spark, texts):
    return spark.createDataFrame([(k, "s1", "daily", t, 10, None, None, ["everyday"]) for k, t in enumerate(texts)], DEAL)


def judges_rows(df):
    """Whether texts are judged where the rows are, and not once a distinct text before."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(word in plan for word in ("regexp_", "RLIKE"))


def test_each_deal_text_is_judged_once(spark):
    judged = spark.sparkContext.accumulator(0)

    def judge(text):
        judged.add(1)
        return f"<{text}>"

    found = promotions.by_text(deals_saying(spark, SAID * 20), icons=F.udf(judge)("description")).collect()
    assert judged.value == len(set(SAID)) and len(found) == 20 * len(SAID)
    assert all(r.icons == f"<{r.description}>" for r in found)


def test_icons_are_judged_by_text(spark):
    from tallyloom.plans.queries import s12_deal_scope, s13_deal_icons

    assert not judges_rows(s13_deal_icons(spark, SF)) and not judges_rows(s12_deal_scope(spark, SF))


def test_selection_is_judged_by_text(spark):
    deals = deals_saying(spark, SAID)
    shown = promotions.selected_deals(deals, "vape")
    assert not judges_rows(shown) and {r.deal_id for r in shown.collect()} == {2, 3, 4, 6}
    assert shown.columns == deals.columns and promotions.selected_deals(deals, None).count() == len(SAID)


def test_descriptions_of_deals_are_cleaned_by_text(spark):
    deals = deals_saying(spark, SAID)
    cleaned = promotions.usable_deals(deals.withColumn("start_time", F.lit(None).cast("string")))
    assert "regexp_" not in cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert {r.deal_id: r.description for r in cleaned.collect()} == {0: "", 1: "", 2: SAID[2], 3: SAID[3], 4: "10% off vape", 5: "", 6: SAID[6]}
    assert cleaned.columns == deals.columns


def test_scopes_are_judged_by_text(spark):
    scoped = promotions.scoped_deals(deals_saying(spark, SAID))
    assert not judges_rows(scoped)
    assert {r.deal_id: r.kind for r in scoped.collect()} == {0: "unresolved", 1: "unresolved", 2: "category", 3: "storewide", 4: "category", 5: "unresolved", 6: "category"}


def test_stores_of_the_feed_that_share_a_best_deal_go_by_id(spark):
    """Line items repeat a deal_id, so stores can be alike in all that the feed is ordered by; deals of unlisted stores are in no feed."""
    stores = [f"s{k:02}" for k in range(40)]
    rows = [(d, s, "daily", "10% off", 10, None, None, ["everyday"]) for s in reversed(["gone", None, *stores]) for d in (8, 9)]
    deals = spark.createDataFrame(rows, DEAL).repartition(3, "dispensary_id")
    places = spark.createDataFrame([(s, 1.5 if s < "s20" else None) for s in reversed(stores)], "dispensary_id string, distance_miles double")
    got = [(r.store_rank, r.dispensary_id, r.deal_rank, r.deal_id) for r in promotions.feed(deals, places, 0).collect()]
    assert sorted(got) == [(k + 1, s, n, d) for k, s in enumerate(stores) for n, d in ((1, 8), (2, 9))]


def test_availability_holds_no_list_for_a_product(spark):
    rows = [("Acme", "s1", "p1", 1.0), ("acme", "s1", "p1", 2.0), ("Acme", "s2", "p1", None), ("Acme", None, "p9", 1.0), (None, "s1", "p2", 1.0), ("Bolt", "s3", None, None)]
    found = brands.availability(spark.createDataFrame(rows, "brand string, dispensary_id string, product_id string, weight_grams double"))
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.brand_key: (r.product_count, r.stores_carrying, r.tiers) for r in found.collect()}
    assert got == {"acme": (2, ["s1", "s2"], [1.0, 2.0]), "bolt": (0, ["s3"], [])}


def test_pairs_of_a_crowded_cell_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(regions, "BLOCK", 10)
    places = spark.range(90).select(F.format_string("s%02d", "id").alias("dispensary_id"), (47 + F.col("id") % 7 * 0.001).alias("lat"), F.lit(-122.0).alias("lng"))
    found = regions.pairs_within(places.coalesce(1))
    assert found.count() == found.select("a", "b").distinct().count() == 90 * 89 // 2
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r[1] for r in tasks) < 90 * 89 // 2 * 0.7


def test_store_matrix_holds_no_list_for_a_product(spark):
    """No grouping counts products and gathers lists at once; odd rows count as before."""
    shape = "brand string, dispensary_id string, product_id string, match_key string, category string, weight_grams double, flags array<string>, quantity_available double, special_price double, base_price double"
    row = lambda brand, store, product, weight, key="k", stock=1.0: (brand, store, product, key, "Flower", weight, [], stock, None, 5.0)
    rows = [row("Ring", "s1", "p1", 3.5), row("Ring", "s1", "p1", 7.0), row("RING ", "s1", "p1", 3.5), row("Ring", "s2", "p2", 1.0, stock=0.0), row("Ring", "s2", None, 3.5, key=None)]
    rows += [row("Ring", None, "p3", 3.5), row("Bolt", "s1", "p4", 3.5, stock=0.0), row(None, "s1", "p5", 3.5, key=None), row(" ", "s3", "p6", 2.0)]
    tally = Tally()
    found = brands.store_matrix(spark.createDataFrame(rows, shape), tally)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "count(distinct" in line and "collect" in line], plan
    got = {r.brand_key: (r.display_brand, r.product_count, r.stores_carrying, r.tiers) for r in found.collect()}
    assert got == {"ring": ("Ring", 3, ["s1", "s2"], [3.5, 7.0]), "bolt": ("Bolt", 1, ["s1"], [])}
    assert tally.counts() == {"null_brand_products": 2, "unmatched_products": 1, "total_brands": 2, "multi_store_brands": 1}
