"""Citations, mentions, candidate threads and alerts: matching, gating, ranking and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, host_matches, mention_key, phrase_present, plain_phrase, url_host
from .ranking import ranked

STOP_WORDS = ["the", "and", "for", "inc", "llc"]
INTENTS = [1, 2, 3, 4, 5, 6]
THRESHOLD = 0.7
SEEN_DAYS = 360


def citation_share(checks: DataFrame) -> DataFrame:
    """By run: questions asked and cited, over engines together; errored checks are counted and nothing else."""
    fine = ~F.col("errored")
    return checks.groupBy("run").agg(
        F.countDistinct(F.when(fine, F.col("question"))).alias("questions"),
        F.countDistinct(F.when(fine & F.col("cited"), F.col("question"))).alias("cited_questions"),
        F.count_if("errored").alias("errors"),
        F.count("*").alias("checks"),
    ).withColumn("share", F.try_divide("cited_questions", "questions"))


def engine_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("engine").agg(
        F.count("*").alias("checks"), F.count_if(F.col("cited") & ~F.col("errored")).alias("cited"), F.count_if("errored").alias("errors")
    )


def rival_ranking(checks: DataFrame, own: str) -> DataFrame:
    """Domains cited other than our own, by checks that name them, then by name."""
    named = checks.where(~F.col("errored")).select("check_id", F.explode(F.array_distinct("domains")).alias("domain"))
    return named.where(~host_matches(F.col("domain"), F.lit(own))).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")


def trend(points: DataFrame, key: str, value: str) -> DataFrame:
    """Each datapoint against the one before it, which is found by its place in the order of all."""
    placed = ranked(points.select(key, value), key, name="_place")
    before = placed.select((F.col("_place") + 1).alias("_place"), F.col(value).alias("previous"))
    return placed.join(before, "_place", "left").select(key, value, "previous", (F.col(value) - F.col("previous")).alias("delta"))


def first_citations(checks: DataFrame) -> DataFrame:
    """(engine, question) with the first run in which it was cited."""
    return checks.where(F.col("cited") & ~F.col("errored")).groupBy("engine", "question").agg(F.min("run").alias("first_run"))


def off_channel(rows: DataFrame, rivals: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is a rival, below one, or missing. rivals: domain.

    Hosts join on each of their suffixes, an equi-join however many rivals there are.
    """
    host = url_host(F.col(url))
    labels = F.split(F.coalesce(host, F.lit("")), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    listed = rows.select(F.col(url).alias("_url"), F.explode(suffixes).alias("domain")).join(rivals.select("domain").distinct(), "domain", "left_semi").select("_url").distinct()
    joined = rows.join(listed, F.col(url) == F.col("_url"), "left")
    return joined.where(F.col("_url").isNotNull() | host.isNull()).drop("_url")


def in_channel(rows: DataFrame, rivals: DataFrame, url: str = "url") -> DataFrame:
    out = off_channel(rows, rivals, url).select(F.col(url).alias("_out")).distinct()
    return rows.where(url_host(F.col(url)).isNotNull()).join(out, F.col(url) == F.col("_out"), "left_anti")


def inventory_tokens(names: DataFrame) -> DataFrame:
    """names: name. Whole phrases and words of three letters or more, without stop words."""
    phrase = names.select(plain_phrase(F.col("name")).alias("phrase")).where("length(phrase) >= 3")
    words = phrase.select(F.explode(F.split("phrase", " ")).alias("token")).where((F.length("token") >= 3) & ~F.col("token").isin(STOP_WORDS))
    return phrase.select(F.col("phrase").alias("token")).unionByName(words).distinct()


def phrase_hits(posts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase), once each: the phrases that stand in a text as whole words. posts: id, text. phrases: phrase.

    Runs of words of the lengths that phrases have are joined to the phrases by equality, so neither the plan nor the work on
    a text grows with the number of phrases. Spark broadcasts the phrases as long as they are few.
    """
    listed = phrases.select("phrase", plain_phrase(F.col("phrase")).alias("_run")).where("_run <> ''").distinct()
    sizes = sorted(r[0] for r in listed.select(F.size(F.split("_run", " "))).distinct().collect())  # lengths of phrases: few
    words = posts.select("id", F.split(plain_phrase(F.col("text")), " ").alias("_w"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
        return F.when(F.size("_w") >= n, F.transform(starts, lambda k: F.array_join(F.slice("_w", k, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *[runs(n) for n in sizes]))
    return words.select("id", F.explode(every).alias("_run")).join(listed, "_run").select("id", "phrase").distinct()


def prefilter_by_tables(posts: DataFrame, places: DataFrame, terms: DataFrame) -> DataFrame:
    """As prefilter, with phrases from tables however large: places and terms: phrase, rank; the lowest rank is named."""
    both = places.select("phrase", "rank", F.lit("geo").alias("kind")).unionByName(terms.select("phrase", "rank", F.lit("term").alias("kind")))
    hits = phrase_hits(posts, both.select("phrase").distinct()).join(both, "phrase")
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("phrase")), F.when(F.col("kind") == kind, F.struct("rank", "phrase"))).alias(kind)
    named = hits.groupBy("id").agg(first("geo"), first("term"))
    found = posts.join(named, "id", "left")
    return found.withColumn("reason", F.when(F.col("geo").isNull(), "no place").when(F.col("term").isNull(), "no product"))


def prefilter(posts: DataFrame, places: list[str], terms: list[str]) -> DataFrame:
    """posts: id, text. Add geo and term, the first of each that stands in the text, and reason if one is missing."""
    text = plain_phrase(F.col("text"))
    first = lambda values: F.coalesce(*[F.when(phrase_present(text, F.lit(v)), v) for v in values])
    found = posts.withColumn("geo", first(places)).withColumn("term", first(terms))
    return found.withColumn("reason", F.when(F.col("geo").isNull(), "no place").when(F.col("term").isNull(), "no product"))


def mentions_brand(text: Column, forms: list[str]) -> Column:
    plain = collapsed(text)
    hit = F.lit(False)
    for form in forms:
        hit = hit | plain.contains(form)
    return hit


def chase_list(mentions: DataFrame, known: DataFrame, rivals: DataFrame, linking: DataFrame, own: str, forms: list[str]) -> DataFrame:
    """New mentions of the brand without a link: not ours, not a rival's, not linking, not known, one per page; newest first.

    mentions: url, title, snippet, posted. known: key. linking: domain.
    """
    host = url_host(F.col("url"))
    text = F.concat_ws(" ", "title", "snippet")
    kept = in_channel(mentions, rivals).where(~host_matches(host, F.lit(own)) & mentions_brand(text, forms)).withColumn("host", host).withColumn("key", mention_key(F.col("url")))
    kept = kept.join(linking.select(F.col("domain").alias("host")).distinct(), "host", "left_anti").join(known.select("key").distinct(), "key", "left_anti")
    first = Window.partitionBy("key").orderBy("url")
    once = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.orderBy(F.col("posted").desc_nulls_last(), "url")


def alerts(classified: DataFrame, seen: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """classified: post_id, position, intent, confidence, fact. One alert per new post of a known intent with a fact and enough confidence."""
    fit = F.col("intent").isin(INTENTS) & F.col("fact").isNotNull() & (F.col("confidence") >= threshold)
    once = Window.partitionBy("post_id").orderBy("position")
    fresh = classified.where(fit).join(seen.select("post_id").distinct(), "post_id", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def unexpired(seen: DataFrame, now: str, days: int = SEEN_DAYS) -> DataFrame:
    """Seen entries of the last `days` days; those without a readable time stay."""
    at = F.try_to_timestamp(F.col("seen_at").cast("string"))
    return seen.where(at.isNull() | (at >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))))


def fit_score(kind: Column, gap: Column, topical: Column, days: Column) -> Column:
    """300, 200 or 100 by kind of fact, a disparity's gap in percent up to 100, 50 for the topic, up to 40 for recency."""
    base = F.when(kind == "regional-floor", 300.0).when(kind == "disparity", 200.0).otherwise(100.0)
    recent = F.coalesce(F.greatest(F.lit(0.0), 40 - 0.4 * days), F.lit(0.0))
    return base + F.when(kind == "disparity", F.least(F.coalesce(gap * 100, F.lit(0.0)), F.lit(100.0))).otherwise(0.0) + F.when(topical, 50.0).otherwise(0.0) + recent
