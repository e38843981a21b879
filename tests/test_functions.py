"""Contracts of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import deals as fd
from tallyloom.functions import numbers as fn
from tallyloom.functions import products as fp
from tallyloom.functions import text as ft
from tallyloom.functions import times


def apply(spark, values, function, schema="x string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r.y for r in df.select("k", function(*[F.col(c) for c in df.columns[1:]]).alias("y")).orderBy("k").collect()]


def test_rounding_is_half_up(spark):
    got = apply(spark, [1.005, 2.675, -2.5, -0.125, 0.125, None], fn.r2, "x double")
    assert got == [1.0, 2.68, -2.5, -0.12, 0.13, None]


def test_grams(spark):
    labels = ["1/8oz", "1/4oz", "1/2oz", "1oz", "3.5g", "1g", "100mg", "2", "1/0oz", "abc", "1.2.3g", "500/1000mg", " 7 grams"]
    assert apply(spark, labels, fp.grams_of) == [3.54, 7.09, 14.17, 28.35, 3.5, 1.0, 0.1, 2.0, None, None, 1.2, 0.0, 7.0]
    labels = ["1/8oz", "3.5g", "1/4oz", "28g", "1oz", "4mg", "3.6g", "abc", "0g"]
    assert apply(spark, labels, fp.canonical_grams) == [3.5, 3.5, 7.0, 28.0, 28.0, None, 3.6, None, None]


def test_pack_count(spark):
    assert apply(spark, ["X PR 2pk", "X 5-pack", "Single 1g", "10ct", "0pk", "3 joints", "2packed"], fp.pack_count) == [2, 5, None, 10, None, 3, None]


def test_name_words(spark):
    names = [("OG Chem OG 1/8oz", "Acme"), ("Acme Banana OG 1g Cartridge", "Acme"), ("707 Headband 3.5g", None), ("2pk flower 0.5", None)]
    assert apply(spark, names, fp.name_words, "x string, b string") == ["chem og og", "banana og", "707 headband", ""]


def test_match_key(spark):
    rows = [("A b", "Br", "Hy", "Concentrate", None), ("", None, None, "Flower", None), ("x", "", None, "Pre-Rolls", "z")]
    key = apply(spark, rows, fp.match_key, "n string, b string, s string, c string, u string")
    assert key == ["br|a b|hy|concentrate|", None, "|x||pre rolls"]


def test_brand_key(spark):
    assert apply(spark, ["Bob's & Co.", "  ", None, "A--B"], fp.brand_key) == ["bob s co", None, None, "a b"]


def test_description(spark):
    long = "word " * 50
    values = ["<b>Hi</b>\x07 there 😀", "This CURES all", "café kids' menu", "kidsmith ok", long, "x" * 200, None, " ​ "]
    got = apply(spark, values, ft.clean_description)
    assert got[:4] == ["Hi there", "", "", "kidsmith ok"] and got[5:] == ["x" * 160, "", ""]
    assert got[4] == ("word " * 32).strip() and len(got[4]) <= 160


def test_urls(spark):
    urls = ["https://www.A.com/X/?q#f", "http://b.co.uk:80", "nope", None, "https://u:p@c.org/a//"]
    assert apply(spark, urls, ft.url_host) == ["a.com", "b.co.uk", None, None, "c.org"]
    assert apply(spark, urls, ft.mention_key) == ["a.com/x", "b.co.uk", None, None, "c.org/a"]
    pairs = [("x.a.com", "a.com"), ("xa.com", "a.com"), ("a.com", "a.com")]
    assert apply(spark, pairs, ft.host_matches, "h string, d string") == [True, False, True]


def test_small_text_functions(spark):
    assert apply(spark, ["12 High St, Everett, WA 98201", "none", "A, B, C, WA 98201-1234"], ft.city_of) == ["Everett", None, "C"]
    assert apply(spark, ["<a href=\"x\">'&"], ft.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]
    assert apply(spark, [([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], ft.join_names, "x array<string>") == ["", "A", "A and B", "A, B and C"]
    assert apply(spark, ["up to 30 % off 20%", "none"], ft.percent_in) == [30, None]
    assert apply(spark, ["Ab & c--D!"], ft.slug) == ["ab-c-d"]


def test_money_and_distance(spark):
    assert apply(spark, [1234.5, 0.004], fn.usd, "x double") == ["$1234.50", "$0.00"]
    assert apply(spark, [30, 15, 1, 0, None], fn.discount_tier, "x int") == ["high", "mid", "low", None, None]
    gas = apply(spark, [(10.0, 4.0, 20.0), (10.0, 0.0, 20.0), (None, 4.0, 20.0), (float("inf"), 4.0, 20.0)], fn.round_trip_gas_cost, "a double, b double, c double")
    assert gas == [4.0, None, None, None]
    far = apply(spark, [(47.0, -122.0, 47.0, -122.0), (0.0, 0.0, 0.0, 180.0), (float("nan"), 0.0, 0.0, 0.0)], fn.haversine_miles, "a double, b double, c double, d double")
    assert far[0] == 0.0 and abs(far[1] - 12436.9) < 1 and far[2] is None


WEEK = ["monday"]


@pytest.mark.parametrize(
    ("days", "start", "end", "day", "minute", "want"),
    [
        (WEEK, None, None, "monday", 0, True),
        (WEEK, None, "10:00", "tuesday", 0, False),
        (WEEK, "09:00", "10:00", "monday", 540, True),
        (WEEK, "09:00", "10:00", "monday", 600, False),
        (WEEK, "22:00", "02:00", "monday", 1330, True),
        (WEEK, "22:00", "02:00", "tuesday", 60, True),
        (WEEK, "22:00", "02:00", "monday", 60, False),
        (["everyday"], "22:00", "02:00", "sunday", 60, True),
    ],
)
def test_deal_active(spark, days, start, end, day, minute, want):
    df = spark.createDataFrame([(days, start, end)], "d array<string>, s string, e string")
    assert df.select(fd.deal_active(F.col("d"), F.col("s"), F.col("e"), day, minute)).first()[0] is want


def test_windows_and_days(spark):
    rows = [("09:00", "10:00"), (None, "10:00"), ("9:00", "10:00"), ("10:00", "10:00"), ("24:00", None)]
    assert apply(spark, rows, fd.usable_window, "a string, b string") == [True, True, False, False, False]
    assert apply(spark, [(["monday", "everyday"],), ([],), (["someday"],), (None,)], fd.usable_days, "x array<string>") == [True, False, False, False]


def test_scope(spark):
    texts = ["All edibles storewide", "Infused pre-roll flower", "20% off your cart", "vape cart", "1/8 oz deal", "an ounce", "Flower", "entire menu", "brand new day", "all brands", "hello"]
    got = [(r.kind, r.category, r.weight_grams) for r in apply(spark, texts, fd.deal_scope)]
    assert got == [
        ("unsupported-category", None, None), ("category", "Pre-Rolls", None), ("unresolved", None, None), ("category", "Vaporizers", None), ("category", "Flower", 3.5),
        ("category", "Flower", 28.0), ("category", "Flower", None), ("storewide", None, None), ("unresolved", None, None), ("brand", None, None), ("unresolved", None, None),
    ]


def test_icons(spark):
    texts = ["Flower & vapes, excludes edibles", "dab rig", "x dabs", "Triple joints", "Join the joint", "storewide 20% off flower", "Any $5 gummy", "orders over $50 wax", "", None]
    assert apply(spark, texts, fd.deal_icons) == [
        ["bud", "vape"], ["glass"], ["dabs"], ["joint-triple"], ["special-pricing"], ["store-wide"], ["edible", "price-drop"], ["dabs"], [], [],
    ]


def test_titles(spark):
    rows = [("20% off Flower", 20.0), ("Up to 50% off - 20% off x", 20.0), ("Flower - 20 % OFF", 20.0), ("5% off 45", 5.0), ("45% off", 5.0), ("x", None)]
    assert apply(spark, rows, fd.without_discount, "t string, p double") == ["Flower", "Up to 50% off - 20% off x", "Flower", "45", "45% off", "x"]
    got = apply(spark, ["Up to 50% Off Sale - 30% Off Brand X", "30% off"], fd.layered_sale)
    assert (got[0].pct, got[0].subject) == (30.0, "Brand X") and got[1] is None
    assert apply(spark, ["Flower PULLMAN", "PULLMAN Flower"], fd.without_location) == ["Flower", "PULLMAN Flower"]


def test_clean_description_is_made_once_a_row(spark):
    cleaned = spark.range(1).select(ft.clean_description(F.concat(F.col("id").cast("string"), F.lit(" ok"))).alias("d"))
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]*>") == 1  # it stood in the plan several times, once for each use
    text = "a  b\tc  ©\U0001f600 d \n" + "e" * 3 + " _cure kid9"
    assert spark.createDataFrame([(text,)], "t string").select(ft.clean_description(F.col("t"))).first()[0] == "a b c d eee _cure kid9"


def test_clock_times(spark):
    texts = ["0:00", "9:05", "09:05", "23:59", "24:00", "9:60", "99:99", "9:5", "009:05", " 9:05", "9:05 ", "9:05\n", "9:05\r\n", "9:05\u2028", "9:05\n\n", "\n9:05", "-1:00", "9:05:00", "٩:05", ":05", "", "x", None]
    assert apply(spark, [(t,) for t in texts], times.clock_minutes, "t string") == [0, 545, 545, 1439, *[None] * 7, 545, 545, 545, *[None] * 9]


@pytest.mark.parametrize("minute", [0, 59, 60, 720, 1439])
def test_window_open_at_and_between_its_ends(spark, minute):
    stated = {"00:00": 0, "0:59": 59, "1:00": 60, "1:01": 61, "11:59": 719, "12:00": 720, "12:01": 721, "23:58": 1438, "23:59": 1439, "24:00": None, "x": None, None: None}
    rows = [(a, b) for a in stated for b in stated]

    def holds(s, e):
        if s is None or e is None:
            return True
        return s <= minute < e if e > s else minute >= s or minute < e

    assert apply(spark, rows, lambda a, b: times.window_open(a, b, minute), "a string, b string") == [holds(stated[a], stated[b]) for a, b in rows]


def test_window_open_reads_each_text_once(spark):
    df = spark.createDataFrame([("09:00", "10:00")], "a string, b string").where(times.window_open(F.col("a"), F.col("b"), 545))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("RLIKE"), plan.count("regexp_extract")) == (2, 0)  # 32 stood there, none of them rlike
