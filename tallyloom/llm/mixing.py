"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Tokens are summed by cell (source, language, topic). Cell weights start at their tokens and are raked
in turn to the target margins of source, language and topic; after each sweep a cell is held to its
supply, since a document can be taken only once. Targets above a value's supply are held to it first,
and sweeps go on until the margins meet their targets. Every document is then drawn with the probability
weight / tokens of its cell, by a hash of its id, so that reruns draw the same documents.

Topics are clusters of hashed word counts of whole texts, fitted on every document. Vectors and centers
are integers, so that distances, sums and hence topics do not depend on how the table is dealt; first
centers are drawn from all different vectors by their squared distance to those before. What comes to the
driver is one vector a center and round, and the centers' sums. Tokens are
pieces of words, numbers and signs, about what a byte-pair vocabulary makes of them; another column of
topics or tokens can take their place.

Defined cases: null source and language are a category of their own; a null text has no tokens and is
drawn with its cell's probability; a cell without tokens is kept whole; a value that a target table does
not name is not held to any weight in that margin, or is not drawn at all if `unnamed` is "drop", and its
rows stay in the output either way; target rows for values that do not occur are ignored, and of repeated
ones the largest counts; repeated rows share one decision; an empty table gives no rows. The decision of
a document depends on its id and cell alone.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, unstage, whole_text

BUDGET = 0.8
POWER = 0.8
SWEEPS = 5000
TOLERANCE = 1e-3
STILL = 1e-12
GATHERED = 20_000
MARGINS = ("source", "lang", "topic")
TOPICS = 8
ROUNDS = 15
BUCKETS = 256
#: Length of a vector of words. Sums of BUCKETS products of such numbers are exact in doubles.
SCALE = 4096
#: No two such vectors are further apart, squared: places are rounded and not below zero.
FAR = 2.0 * (SCALE + BUCKETS**0.5 / 2) ** 2
DRAWS = 1000
#: Up to six letters, up to three digits, or one other sign: about one token of a byte-pair vocabulary each.
PIECE = r"\p{L}{1,6}+|\p{N}{1,3}+|[^\s\p{L}\p{N}]"
#: The same with the white space behind it: of a text that doesn't begin with such, nothing is left between them.
SPACED = r"\p{L}{1,6}+\s*+|\p{N}{1,3}+\s*+|\S\s*+"
LOG = logging.getLogger(__name__)


def _counted(rows: DataFrame, text: str) -> DataFrame:
    """rows with _point: hashed word counts of the text as a whole-numbered vector of length SCALE; without words zero."""
    cut = rows.withColumn("_words", F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""))
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=BUCKETS)
    scaled = Normalizer(inputCol="_counts", outputCol="_vector").transform(counts.transform(cut))
    point = F.transform(vector_to_array("_vector"), lambda x: F.rint(x * SCALE).cast("short"))
    return scaled.withColumn("_point", point).drop("_words", "_counts", "_vector")


def pieces(text: Column) -> Column:
    """The count of PIECE in a text, without a list of them: each becomes one sign, as does one put before white space at the start."""
    return F.length(F.regexp_replace(F.concat(F.lit("."), text), SPACED, ".")) - 1


def _vector(point: Column) -> Column:
    return array_to_vector(point.cast("array<double>"))


def _square(point: Column, center: np.ndarray) -> Column:
    """Squared distance of a point to a center, exact."""
    apart = F.zip_with(point, F.lit(center.astype(np.float64)), lambda a, b: (a - b) * (a - b))
    return F.aggregate(apart, F.lit(0.0), lambda t, x: t + x)


def _first_centers(points: DataFrame, topics: int, draws: int = DRAWS) -> np.ndarray:
    """Up to `topics` different vectors, each drawn from all points with odds of its squared distance to those before.

    A vector's turn is -log(u) / distance with u from its own hash, and the smallest turn of all is drawn. Ties go to the
    smaller vector. No distance exceeds FAR, so the smallest turn among the `draws` largest u tells below which u no vector
    comes first; the distances of all others are computed. The centers stand in the text of each plan, which the driver
    keeps: so they are named once, and what is made of them is short. points: different ones.
    """
    centers = np.zeros((0, BUCKETS), np.int64)
    while len(centers) < topics:
        hashed = F.xxhash64(F.lit(len(centers)), "_point").bitwiseAND(F.lit((1 << 52) - 1))
        odds = points.select(((hashed + 0.5) / float(1 << 52)).alias("_u"), "_point")
        apart = F.least(F.lit(FAR), F.lit(FAR), *[_square(F.col("_point"), c) for c in centers])
        turn = _let(apart, lambda a: F.when(a > 0, F.struct((-F.log("_u") / a).alias("turn"), "_point")))
        smallest = F.min(turn).alias("smallest")
        found = odds.orderBy(F.desc("_u"), "_point").limit(draws).agg(smallest).first()[0]
        least = 0.0 if found is None else math.exp(-found["turn"] * FAR) * (1 - 1e-9)
        found = odds.where(F.col("_u") >= least).agg(smallest).first()[0]
        if found is None:
            break
        centers = np.vstack([centers, np.array(found["_point"], np.int64)[None, :]])
    return centers


def nearest(spark: SparkSession, centers: np.ndarray) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds to rows with a _vector the number of the nearest center, of equally near ones always the same.

    Clusters of the centers alone are the centers: so Spark's model comes to hold them, which finds the nearest much faster
    than expressions do.
    """
    place = {tuple(c): k for k, c in reversed(list(enumerate(centers.tolist())))}
    table = spark.createDataFrame([([float(x) for x in c],) for c in place], "at array<double>").coalesce(1)
    means = KMeans(k=max(2, len(place)), initMode="random", seed=11, maxIter=1, solver="row", featuresCol="_vector", predictionCol="_near")
    model = means.fit(table.select(array_to_vector("at").alias("_vector")))
    own = F.lit(np.array([place[tuple(np.rint(c).astype(int).tolist())] for c in model.clusterCenters()], np.int32))
    return lambda rows, name: model.transform(rows).withColumn(name, own[F.col("_near")]).drop("_near")


def fit_topics(points: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> np.ndarray | None:
    """Cluster centers of all points; None where these do not differ.

    A round assigns every point to its nearest center and replaces each center by its points' mean, rounded; it ends
    early when no center moves. points: staged, with _point and, if it is there, its _vector.
    """
    if own := "_vector" not in points.columns:
        points = stage(points.select("_point", _vector(F.col("_point")).alias("_vector")), "points")
    centers = _first_centers(points, topics)
    if len(centers) < 2:
        return None
    # of places that are whole and not below zero, sums of magnitudes: exact in doubles
    sums = [vector_to_array(Summarizer.normL1(F.col("_vector"))).alias("t"), F.count("*").alias("n")]
    for _ in range(rounds):
        after = centers.copy()
        for r in nearest(points.sparkSession, centers)(points, "_now").groupBy("_now").agg(*sums).collect():  # a row a center
            after[r["_now"]] = (2 * np.array(r["t"]).astype(np.int64) + r["n"]) // (2 * r["n"])
        if (after == centers).all():
            break
        centers = after
    if own:
        unstage(points)
    return centers


def topic_of(point: Column, centers: np.ndarray) -> Column:
    """The number of the center nearest to a point, of equally near ones the smaller, as a column; see also nearest()."""
    apart = F.array(*[_square(point, c) for c in centers])
    return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")


def with_cells(documents: DataFrame, topic: Column | None = None, tokens: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Add _source, _lang, _topic and _tokens to the documents; columns of these names are replaced.

    topic: a column; by default clusters of the texts. tokens: a count; by default pieces of the text. columns: those of
    the documents to keep; if given, what is kept of a row is staged and texts are read once.
    """
    own = ["_source", "_lang", "_topic", "_tokens", "_probability", "_drawn", "_text", "_words", "_counts", "_point", "_vector", "_near"]
    none = F.lit("(none)")
    rows = documents.drop(*own)
    counted = pieces(whole_text()) if tokens is None else F.coalesce(tokens, F.lit(0))
    rows = rows.select(
        "*",
        F.coalesce(F.col("source").cast("string"), none).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), none).alias("_lang"),
        counted.cast("long").alias("_tokens"),
        *([] if topic is None else [F.coalesce(topic.cast("string"), none).alias("_topic")]),
    )
    kept = ["_source", "_lang", "_tokens"]
    if topic is not None:
        return rows if columns is None else stage(rows.select(*columns, *kept, "_topic"), "rows")
    rows = _counted(rows.withColumn("_text", whole_text()), "_text").drop("_text")
    rows = rows.withColumn("_vector", _vector(F.col("_point")))
    if columns is not None:
        rows = stage(rows.select(*columns, *kept, "_point", "_vector"), "counted")
    centers = fit_topics(rows if columns is not None else stage(rows.select("_point", "_vector"), "points"))
    if centers is None:
        numbered = rows.withColumn("_topic", F.lit(0))
    else:
        numbered = nearest(rows.sparkSession, centers)(rows, "_topic")
    placed = numbered.withColumn("_topic", F.concat(F.lit("topic "), F.col("_topic").cast("string"))).drop("_point", "_vector")
    return placed if columns is None else stage(placed, "rows")


def tempered(cells: DataFrame, column: str, power: float, total: float) -> DataFrame:
    """Target tokens by value of a margin: shares raised to `power` and scaled to sum to `total`."""
    sums = cells.groupBy(column).agg(F.sum("_tokens").alias("_t"))
    raised = sums.select(column, F.pow(F.col("_t").cast("double"), F.lit(power)).alias("_r"))
    norm = raised.agg(F.coalesce(F.sum("_r"), F.lit(0.0))).first()[0] or 1.0
    return raised.select(column, (F.col("_r") / norm * total).alias("_target"))


def attainable(cells: DataFrame, column: str, target: DataFrame) -> DataFrame:
    """Targets of a margin held to the supply of each value, the excess shared out over the others in proportion.

    Values are filled in order of supply per target; the first that can take its share of what is left
    gives the rate of all that follow. If the targets ask for more than there is, each gets its supply.
    """
    supply = cells.groupBy(column).agg(F.sum("_tokens").cast("double").alias("_supply"))
    asked = target.groupBy(column).agg(F.max(F.col("_target").cast("double")).alias("_target")).where("_target is not null")
    known = asked.join(supply, column)
    room = F.when(F.col("_target") > 0, F.col("_supply") / F.col("_target")).otherwise(float("inf"))
    row = known.agg(F.sort_array(F.collect_list(F.struct(room.alias("room"), F.col(column).alias("value"), F.col("_target").alias("target"), F.col("_supply").alias("supply")))).alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda t, v: t + v["target"])
    start = F.struct(total.alias("left"), total.alias("asked"), F.lit(1.0).alias("rate"), F.lit(False).alias("done"))

    def fill(acc: Column, v: Column) -> Column:
        rate = acc["left"] / acc["asked"]
        stop = F.struct(acc["left"].alias("left"), acc["asked"].alias("asked"), rate.alias("rate"), F.lit(True).alias("done"))
        go = F.struct((acc["left"] - v["supply"]).alias("left"), (acc["asked"] - v["target"]).alias("asked"), rate.alias("rate"), F.lit(False).alias("done"))
        return F.when(acc["done"] | (acc["asked"] <= 0) | (v["target"] <= 0), acc).when(v["room"] >= rate, stop).otherwise(go)

    rated = row.select(F.aggregate("_v", start, fill, lambda acc: acc["rate"]).alias("_rate"), "_v")
    values = rated.select("_rate", F.explode("_v").alias("v"))
    return values.select(F.col("v.value").alias(column), F.least(F.col("v.supply"), F.col("v.target") * F.col("_rate")).alias("_target"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], budget: float, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, gathered: int = GATHERED, unnamed: str = "keep"
) -> DataFrame:
    """cells: staged cell columns and _tokens. Adds _weight, whose margins meet the attainable targets, and for each
    margin its target (_target and the column's name; null where the targets do not name the value). No cell is lost.

    Sweeps end when no margin is off its target by more than `tolerance` of it, or when the weights stand
    still (cells can fall short together where no single value does). A warning gives the largest
    deviation that is left above the tolerance. Up to `gathered` cells are raked as arrays in one row,
    so a sweep costs no job; more are swept as tables.
    """
    now = cells.withColumn("_weight", F.col("_tokens") * F.lit(float(budget)))
    for column, target in targets.items():
        wanted = attainable(cells, column, target).withColumnRenamed("_target", f"_target{column}")
        now = now.join(wanted, column, "left")
        if unnamed == "drop":
            now = now.withColumn(f"_target{column}", F.coalesce(f"_target{column}", F.lit(0.0)))
    now = stage(now, "cells")
    sweep = _sweep_arrays if now.count() <= gathered else _sweep_tables
    raked, n, off = sweep(now, list(targets), sweeps, tolerance)
    if off > tolerance:
        LOG.warning("raking ended after %d sweeps with a margin %.2g of its target away from it (tolerance %.2g)", n, off, tolerance)
    return raked


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _sweep_arrays(cells: DataFrame, columns: list[str], sweeps: int, tolerance: float) -> tuple[DataFrame, int, float]:
    """The cells raked in one row: an array of weights, and by margin the places and target of each value."""
    row = cells.agg(F.sort_array(F.collect_list(F.struct(*columns, *[c for c in cells.columns if c not in columns]))).alias("_c"))
    placed = stage(row.select(F.posexplode("_c").alias("_at", "_c")).select("_at", "_c.*"), "placed")
    tokens = F.transform("_c", lambda c: c["_tokens"].cast("double"))
    state = placed.agg(F.sort_array(F.collect_list(F.struct("_at", "_tokens", "_weight"))).alias("_c"))
    state = state.select(tokens.alias("_cap"), F.transform("_c", lambda c: c["_weight"]).alias("_w"))
    for k, column in enumerate(columns):
        values = placed.groupBy(column).agg(F.sort_array(F.collect_list("_at")).alias("at"), F.max(f"_target{column}").alias("want"))
        margin = values.agg(F.sort_array(F.collect_list(F.struct("at", "want"))).alias(f"_m{k}"))
        spots = F.flatten(F.transform(f"_m{k}", lambda v, j: F.transform(v["at"], lambda i: F.struct(i.alias("i"), j.alias("j")))))
        state = state.crossJoin(margin.withColumn(f"_of{k}", F.transform(F.sort_array(spots), lambda s: s["j"])))
    state = stage(state, "raking")

    def have(weights: Column, value: Column) -> Column:
        return F.aggregate(value["at"], F.lit(0.0), lambda t, i: t + weights[i])

    def scaled(weights: Column, k: int) -> Column:
        rate = lambda v: _let(have(weights, v), lambda h: F.when((h > 0) & v["want"].isNotNull(), v["want"] / h).otherwise(1.0))
        return _let(F.transform(f"_m{k}", rate), lambda r: F.transform(weights, lambda w, i: w * r[F.col(f"_of{k}")[i]]))

    def after(weights: Column, k: int, done: Callable[[Column], Column]) -> Column:
        if k < len(columns):
            return _let(scaled(weights, k), lambda w: after(w, k + 1, done))
        # after a sweep no cell is asked for more than it has
        return _let(F.zip_with(weights, "_cap", lambda w, c: F.least(w, c)), done)

    def off(weights: Column) -> Column:
        apart = lambda v: F.when(v["want"] > 0, F.abs(have(weights, v) / v["want"] - 1)).otherwise(0.0)
        return F.greatest(F.lit(0.0), *[F.array_max(F.transform(f"_m{k}", apart)) for k in range(len(columns))])

    def swept(acc: Column, _: Column) -> Column:
        def done(w: Column) -> Column:
            moved = F.aggregate(F.zip_with(w, acc["w"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, x: t + x)
            all_of = F.aggregate(w, F.lit(0.0), lambda t, x: t + x)
            return F.struct(w.alias("w"), off(w).alias("off"), (acc["n"] + 1).alias("n"), (moved <= all_of * STILL).alias("still"))

        return F.when((acc["off"] <= tolerance) | acc["still"], acc).otherwise(after(acc["w"], 0, done))

    start = F.struct(F.col("_w").alias("w"), F.lit(float("inf")).alias("off"), F.lit(0).alias("n"), F.lit(False).alias("still"))
    ended = stage(state.select(F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, swept).alias("_e")).select("_e.*"), "raked")
    n, left = ended.select("n", "off").first()
    weights = ended.select(F.posexplode("w").alias("_at", "_weight"))
    raked = placed.drop("_weight").join(weights, "_at").drop("_at")
    return raked, n, left if n else 0.0


def _sweep_tables(cells: DataFrame, columns: list[str], sweeps: int, tolerance: float) -> tuple[DataFrame, int, float]:
    """The same as tables, for more cells than a row should hold.

    Each step is one grouped sum and one join on a margin, and is written to the shared folder, so plans
    stay small. How far the margins are off and a sweep moved the weights is all that comes to the driver.
    """
    now = stage(cells.withColumn("_was", F.col("_weight")), "cells")
    n, off = 0, 0.0
    for n in range(1, sweeps + 1):
        for k, column in enumerate(columns):
            have = now.groupBy(column).agg(F.sum("_weight").alias("_have"), F.max(f"_target{column}").alias("_want"))
            rate = have.select(column, F.when((F.col("_have") > 0) & F.col("_want").isNotNull(), F.col("_want") / F.col("_have")).otherwise(1.0).alias("_rate"))
            weight = F.col("_weight") * F.col("_rate")
            if k == len(columns) - 1:  # after a sweep no cell is asked for more than it has
                weight = F.least(weight, F.col("_tokens").cast("double"))
            was = F.col("_weight") if k == 0 else F.col("_was")
            moved = now.join(rate, column).withColumn("_was", was).withColumn("_weight", weight).drop("_rate")
            last, now = now, stage(moved, "cells")
            unstage(last)
        margins = [now.groupBy(c).agg(F.sum("_weight").alias("_have"), F.max(f"_target{c}").alias("_want")).select("_have", "_want") for c in columns]
        apart = F.when(F.col("_want") > 0, F.abs(F.col("_have") / F.col("_want") - 1)).otherwise(0.0)
        off = reduce(DataFrame.unionAll, margins).agg(F.max(apart)).first()[0] or 0.0
        still = now.agg(F.sum(F.abs(F.col("_weight") - F.col("_was"))) <= F.sum("_weight") * STILL).first()[0]
        if off <= tolerance or still:
            break
    return now, n, off


def drawn(doc_id: Column, probability: Column, seed: int) -> Column:
    uniform = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) / float(1 << 52)
    return uniform < probability


def mix(
    documents: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    power: float = POWER,
    seed: int = 7,
    topic: Column | None = None,
    tokens: Column | None = None,
    unnamed: str = "keep",
    columns: list[str] | None = None,
) -> DataFrame:
    """The documents with _source, _lang, _topic, _tokens, _probability and _drawn; as many rows as come in.

    targets: by margin a table (value column named like the cell column, _target in tokens); else the
    corpus shares tempered by `power`. budget: share of all tokens to draw. columns: those of the documents
    to keep; if given, texts are read once and what is kept of a row is staged, else texts are read again.
    """
    rows = with_cells(documents, topic, tokens, columns)
    names = [f"_{m}" for m in MARGINS]
    weighed = weigh(rows, targets, budget, power, unnamed)
    # rounded, as sums of doubles depend on the order of rows in their last digits
    chance = F.round(F.when(F.col("_tokens") > 0, F.least(F.lit(1.0), F.col("_weight") / F.col("_tokens"))).otherwise(1.0), 9)
    rates = stage(weighed.select(*names, chance.alias("_probability")), "rates")
    return rows.join(rates, names, "left").withColumn("_drawn", drawn(F.col("doc_id"), F.col("_probability"), seed))


def weigh(rows: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, power: float = POWER, unnamed: str = "keep") -> DataFrame:
    """The cells of rows (see with_cells) with _tokens, their targets and _weight."""
    names = [f"_{m}" for m in MARGINS]
    cells = stage(rows.groupBy(*names).agg(F.sum("_tokens").alias("_tokens")), "supply")
    total = cells.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0] * budget
    goals = targets or {n: stage(tempered(cells, n, power, total), "target") for n in names}
    return rake(cells, goals, budget, unnamed=unnamed)


def margins(weighed: DataFrame) -> DataFrame:
    """What a mix delivers, by margin and value: its supply, its target, the tokens expected and their shares of all tokens.

    Targets are those that can be attained; a null one holds the value to nothing. weighed: from weigh().
    """
    total = weighed.agg(F.sum("_tokens")).first()[0] or 1
    found = [
        weighed.groupBy(F.lit(m).alias("margin"), F.col(f"_{m}").alias("value")).agg(
            F.sum("_tokens").alias("supply"), F.max(f"_target_{m}").alias("target"), F.sum(F.least("_weight", F.col("_tokens").cast("double"))).alias("expected")
        )
        for m in MARGINS
        if f"_target_{m}" in weighed.columns
    ]
    return reduce(DataFrame.unionByName, found).withColumn("expected_share", F.col("expected") / total)


def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled: one row per document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id", "source", "lang"])
    return mixed.select(
        "doc_id",
        "source",
        "lang",
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"),
        F.col("_drawn").alias("sampled"),
    )
