"""The one fact that answers a question about a topic and a place, and candidates paired with such facts.

Sources, one row a fact:
floors: region, category, display_name, weight_grams, floor_price, stale. gaps: the cells of price gaps.
drops: dispensary_id, region (null outside all), category, name, current_price, median_price, pct_vs_median.
names: what place_names makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import LOCALITIES, OUTSIDE, channel, place_kind, topic_fits
from ..functions.numbers import drop_percent, positive, usd
from ..functions.text import phrase_present, plain_phrase, slug
from ..functions.times import fact_freshness
from .outreach import fit_score, in_channel
from .ranking import ranked

BRAND_INTENTS = (2, 6)
CATEGORIES = ["Flower", "Vaporizers", "Pre-Rolls", "Concentrate", "Edible"]


def place_names(regions: DataFrame, members: DataFrame, cities: DataFrame) -> DataFrame:
    """by, name, region, cluster_id: each region under its slug, its label and the cities of its stores, in lower case."""
    at = regions.select("cluster_id", F.col("slug").alias("region"), "label")
    inside = members.select("cluster_id", "dispensary_id").join(cities.select("dispensary_id", "city"), "dispensary_id").select("cluster_id", "city").distinct()
    named = lambda rows, by, name: rows.select(F.lit(by).alias("by"), F.lower(F.trim(name)).alias("name"), "region", "cluster_id")
    cities_of = named(at.join(inside, "cluster_id"), "name", F.col("city"))
    return named(at, "slug", F.col("region")).unionByName(named(at, "name", F.col("label"))).unionByName(cities_of).distinct()


def resolved(asks: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (topic, place) with place_kind and region; null counts as empty, of several regions the first cluster's is meant."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    asked = asks.select(text("topic").alias("topic"), text("place").alias("place")).distinct()
    place = F.lower("place")
    keys = F.array(F.struct(F.lit("slug").alias("by"), slug(place).alias("name")), F.struct(F.lit("name").alias("by"), place.alias("name")))
    places = asked.select("place").distinct().select("place", F.explode(keys).alias("k")).select("place", "k.*").where("name <> ''")
    met = places.join(names, ["by", "name"]).groupBy("place").agg(F.min_by("region", F.struct("cluster_id", "region")).alias("region"))
    kind = F.when(F.col("region").isNotNull(), "region").otherwise(place_kind(F.col("place"), F.array().cast("array<string>")))
    return asked.join(met, "place", "left").select("topic", "place", kind.alias("place_kind"), "region")


def _best(rows: DataFrame, keys: list[str], order: list[Column], carried: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *carried)).alias(name))


def select_facts(asks: DataFrame, floors: DataFrame, gaps: DataFrame, drops: DataFrame, names: DataFrame, refuse: bool = True, categories: list[str] = CATEGORIES) -> DataFrame:
    """One row per distinct (topic, place) of the asks, with the fact that answers it or the reason why none does.

    In order: the lowest floor of the place's region with a live holder, else the widest real gap anywhere, else the
    deepest drop below a product's own median, within the region if there is one. Topics meet categories loosely.
    Places out of the state and names that mean nothing are refused; with refuse=False they ask for the whole state.
    kind is regional-floor, disparity, own-median or none. categories: the names that facts go by.

    Facts are cut to the best of each category (and region) before any ask meets them, so the joins are of small tables.
    """
    fitting = F.filter(F.array(*[F.lit(c) for c in categories]), lambda c: topic_fits(F.col("topic"), c))
    asked = resolved(asks, names)
    pairs = asked.select("topic", "place", "region", F.explode(fitting).alias("category"))

    live = floors.where(~F.coalesce(F.col("stale"), F.lit(False)) & positive(F.col("floor_price")) & F.col("region").isNotNull())
    low = [F.col("floor_price"), F.col("display_name"), F.col("weight_grams")]
    best_floor = _best(live, ["region", "category"], low, ["category"], "floor")

    real = gaps.where((F.col("high_price") > F.col("low_price")) & positive(F.col("low_price")) & positive(F.col("high_price")) & (F.size("stores_carrying") >= 2))
    wide = [-F.col("spread_pct"), F.col("low_price"), F.col("display_name"), F.col("weight_grams")]
    best_gap = _best(real.withColumn("low_store", F.col("stores_carrying")[0]["dispensary_id"]), ["category"], wide, ["category", "high_price", "low_store"], "gap")

    told = drops.where((F.col("pct_vs_median") < 0) & (drop_percent(F.col("pct_vs_median")) >= 1) & positive(F.col("current_price")) & positive(F.col("median_price")))
    deep = [F.col("pct_vs_median"), F.col("name"), F.col("dispensary_id")]
    best_drop = _best(told, ["region", "category"], deep, ["category", "current_price", "median_price"], "near_drop")
    any_drop = best_drop.groupBy("category").agg(F.min("near_drop").alias("any_drop"))

    met = pairs.join(best_floor, ["region", "category"], "left").join(best_gap, "category", "left").join(best_drop, ["region", "category"], "left").join(any_drop, "category", "left")
    drop = F.when(F.col("region").isNull(), F.col("any_drop")).otherwise(F.col("near_drop"))
    found = met.groupBy("topic", "place").agg(F.min("floor").alias("f"), F.min("gap").alias("g"), F.min(drop).alias("d"))
    out = asked.join(found, ["topic", "place"], "left")

    refused = F.lit(None).cast("string")
    if refuse:
        refused = F.when(F.col("place_kind") == "outside", "outside the state").when((F.col("place_kind") == "uncovered") & (F.col("place") != ""), "unknown place")
    kind = F.when(refused.isNotNull(), "none").when(F.col("f").isNotNull(), "regional-floor").when(F.col("g").isNotNull(), "disparity").when(F.col("d").isNotNull(), "own-median").otherwise("none")
    out = out.withColumn("kind", kind).withColumn("reason", F.coalesce(refused, F.when(F.col("kind") == "none", "no fact")))
    of = lambda floor, gap, own: F.when(F.col("kind") == "regional-floor", floor).when(F.col("kind") == "disparity", gap).when(F.col("kind") == "own-median", own)
    none = F.lit(None)
    return out.select(
        "topic",
        "place",
        "place_kind",
        "region",
        "kind",
        of(F.col("f.category"), F.col("g.category"), F.col("d.category")).alias("category"),
        of(F.col("f.o1"), F.col("g.o2"), F.col("d.o1")).alias("name"),
        of(F.col("f.o2"), F.col("g.o3"), none).alias("weight_grams"),
        of(F.col("f.o0"), F.col("g.o1"), F.col("d.current_price")).alias("price"),
        of(none, F.col("g.high_price"), F.col("d.median_price")).alias("against_price"),
        of(none, F.col("g.low_store"), F.col("d.o2")).alias("dispensary_id"),
        of(none, none, drop_percent(F.col("d.o0"))).alias("drop_percent"),
        "reason",
    )


def concerns_brand(name: Column, brand: Column) -> Column:
    """Whether a fact's name holds the brand in whole words; no brand concerns none."""
    wanted = plain_phrase(brand)
    return (wanted != "") & phrase_present(plain_phrase(name), wanted)


def mention_candidates(posts: DataFrame, dated: DataFrame, now: str, **sources: DataFrame) -> DataFrame:
    """Classified posts with the fact that answers each, and how fresh that is: fact, name, category, region, price, fact_as_of, freshness.

    posts: post_id, topic, place, intent, brand. dated: kind, as_of, a row for each kind of fact. Posts without an intent or
    of intent 0 are left out. The fact is chosen by topic and place; for the intents that ask about one brand it is none
    unless it is about that brand. Each kind of fact is as fresh as the run that made it; no fact has no freshness.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    asked = posts.where("intent <> 0").withColumns({"_topic": text("topic"), "_place": text("place")})
    chosen = select_facts(asked.select(F.col("_topic").alias("topic"), F.col("_place").alias("place")), **sources)
    columns = ["name", "category", "region", "price"]
    chosen = chosen.select(F.col("topic").alias("_topic"), F.col("place").alias("_place"), F.col("kind").alias("_kind"), *[F.col(c).alias(f"_{c}") for c in columns])
    met = asked.join(chosen, ["_topic", "_place"])
    unlike = F.col("intent").isin(*BRAND_INTENTS) & (text("brand") != "") & ~concerns_brand(F.col("_name"), F.col("brand"))
    kept = (F.col("_kind") != "none") & ~F.coalesce(unlike, F.lit(False))
    own = {"fact": F.when(kept, F.col("_kind"))} | {c: F.when(kept, F.col(f"_{c}")) for c in columns}
    stamped = met.select(*[c for c in posts.columns if c not in own], *[v.alias(c) for c, v in own.items()])
    stamped = stamped.join(dated.select(F.col("kind").alias("fact"), F.col("as_of").alias("fact_as_of")), "fact", "left")
    return stamped.withColumn("freshness", F.when(F.col("fact").isNull(), "").otherwise(fact_freshness(F.coalesce("fact_as_of", F.lit("")), now)))


def in_state(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates about the state: by their place, or, where that says nothing, by title, snippet and place together.

    Such a text must name the state, a locality or a place of a region in whole words and nothing outside; abbreviations of
    other states do not count in prose. Texts meet the names by their first words, an equi-join.
    """
    text = plain_phrase(F.concat_ws(" ", "title", "snippet", "geo"))
    own = F.trim(F.coalesce(F.col("geo"), F.lit("")))
    kinds = resolved(candidates.select(F.lit("").alias("topic"), own.alias("place")), names).select(F.col("place").alias("_place"), "place_kind")
    known = candidates.withColumn("_text", text).withColumn("_place", own).join(kinds, "_place")
    phrases = names.select(plain_phrase(F.col("name")).alias("phrase")).where("phrase <> ''").distinct().withColumn("word", F.split_part("phrase", F.lit(" "), F.lit(1)))
    words = known.where("place_kind = 'uncovered'").select("_text").distinct().select("_text", F.explode(F.array_distinct(F.split("_text", " "))).alias("word"))
    naming = words.join(phrases, "word").where(phrase_present(F.col("_text"), F.col("phrase"))).select("_text", F.lit(True).alias("_named")).distinct()
    told = F.split("_text", " ")
    any_of = lambda values: F.arrays_overlap(told, F.array(*[F.lit(v) for v in values]))
    inside = any_of(["wa", "washington", *LOCALITIES]) | F.coalesce(F.col("_named"), F.lit(False))
    outside = any_of([w for w in OUTSIDE if len(w) >= 3])
    kept = F.col("place_kind").isin("region", "statewide") | ((F.col("place_kind") == "uncovered") & inside & ~outside)
    return known.join(naming, "_text", "left").where(kept).drop("_text", "_place", "_named", "place_kind")


def paired(candidates: DataFrame, floors: DataFrame, gaps: DataFrame, drops: DataFrame, names: DataFrame, rivals: DataFrame, now: str, topic: str = "", place: str = "") -> DataFrame:
    """Candidates in channel and in the state that a fact answers, with fact, channel and fit_score.

    candidates: url, title, snippet, topic, geo, posted. topic and place serve candidates without their own (null).
    """
    of = lambda c, other: F.trim(F.coalesce(F.col(c), F.lit(other)))
    kept = in_state(in_channel(candidates, rivals), names).withColumn("_topic", of("topic", topic)).withColumn("_place", of("geo", place))
    asks = kept.select(F.col("_topic").alias("topic"), F.col("_place").alias("place"))
    facts = select_facts(asks, floors, gaps, drops, names, refuse=False).where("kind <> 'none'").withColumnsRenamed({"topic": "_topic", "place": "_place"})
    met = kept.join(facts.drop("place_kind", "reason"), ["_topic", "_place"])
    own = F.trim(F.coalesce(F.col("topic"), F.lit("")))
    days = F.abs(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.try_to_timestamp(F.col("posted").cast("string")))) / 86_400_000_000
    gap = (F.col("against_price") - F.col("price")) / F.col("price")
    score = fit_score(F.col("kind"), gap, (own != "") & topic_fits(own, F.col("category")), days)
    return met.withColumn("channel", channel(F.col("url"))).withColumn("fit_score", score).drop("_topic", "_place")


def worklist(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """The best `limit` of the paired candidates by score, then by URL."""
    return pairs.orderBy(F.desc("fit_score"), "url").limit(limit)


def worklist_lines(best: DataFrame, counters: DataFrame, generated_at: str) -> DataFrame:
    """(n, line): the worklist as a page of Markdown, in order. best: of worklist, so few rows; counters: of worklist_counters.

    Each row becomes a heading with its place, its thread with the day of posting if known, its channel and its fact.
    """
    place = ranked(best, F.desc("fit_score"), "url", name="_place")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url"))
    posted = F.when(F.try_to_timestamp(F.col("posted").cast("string")).isNotNull(), F.concat(F.lit(" ("), F.col("posted").cast("string"), F.lit(")"))).otherwise("")
    fact = F.concat_ws(" ", "kind", F.concat(F.lit("in "), F.col("category")), F.concat(F.lit("at "), usd(F.col("price"))))
    of_row = F.array(
        F.concat(F.lit("## "), F.col("_place").cast("string"), F.lit(". "), title),
        F.concat(F.lit("- Thread: "), F.col("url"), posted),
        F.concat(F.lit("- Channel: "), F.col("channel")),
        F.concat(F.lit("- Fact: "), fact),
        F.lit(""),
    )
    lines = place.select("_place", F.posexplode(of_row)).select((F.col("_place") * 5 + F.col("pos")).alias("n"), F.col("col").alias("line"))
    told = F.concat(F.lit(f"Generated {generated_at}. Scanned "), F.col("scanned").cast("string"), F.lit(", kept "), F.col("kept").cast("string"), F.lit("."))
    head = F.array(F.lit("# Worklist"), F.lit(""), told, F.coalesce(F.concat(F.lit("Nothing to act on: "), F.col("reason"), F.lit(".")), F.lit("")))
    return counters.select(F.posexplode(head)).select(F.col("pos").cast("long").alias("n"), F.col("col").alias("line")).unionByName(lines.withColumn("n", F.col("n").cast("long")))


def worklist_counters(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: candidates scanned and kept, and the reason where none was."""
    both = candidates.agg(F.count("*").alias("scanned")).crossJoin(pairs.agg(F.count("*").alias("kept")))
    return both.withColumn("reason", F.when(F.col("scanned") == 0, "no candidates").when(F.col("kept") == 0, "none fits"))
