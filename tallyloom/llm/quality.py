"""Quality by hierarchical empirical Bayes.

A logistic classifier over kinds of characters and hashed words, fitted on a bounded sample of labelled
documents, gives each document its evidence. Evidence is pooled by host and by path within the host: a
host's rate of good documents is shrunk toward the global rate and a path's toward its host's, the more
the fewer documents it has. How strongly is estimated from the spread of the rates themselves. A
document's own evidence is left out of the rates that it is judged by, so it counts once: its score is its
log-odds with the global prior replaced by that of its path without it.

Defined cases: null texts count as empty; null hosts and paths are values of their own; the only document
of a path has its host's rate, the only one of a host the global rate; without labels of both classes
every document keeps the score 0.5 and stays; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, whole_text

SAMPLE = 20_000
BLOCK = 1000
THRESHOLD = 0.5
LIMITS = (0.005, 0.995)
BUCKETS = 256
SYMBOLS = b"#$%&*|!"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(text: str) -> np.ndarray:
    """Shares of kinds of characters, repetition of words, length, and hashed word counts, over the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, n_words = max(len(raw), 1), max(len(words), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    counts = Counter(words)
    distinct, upper = len(counts), share(UPPER)
    out = np.zeros(KINDS + BUCKETS, np.float32)
    out[:KINDS] = (
        math.sqrt(share(SYMBOLS)),
        upper,
        distinct / math.sqrt(n_words) / 10,
        distinct / n_words,
        math.log1p(n_words) / 5,
        min(n / n_words, 40.0) / 10,
        math.sqrt(share(b".,;:?")),
        math.sqrt(share(b"0123456789")),
        math.sqrt(share(b"\n")),
        float(upper > 0.3),
    )
    digest = xxhash.xxh32_intdigest
    places = np.fromiter((digest(w.lower()) % BUCKETS for w in counts), np.int64, distinct)
    hashed = np.bincount(places, np.fromiter(counts.values(), np.float64, distinct), BUCKETS)
    out[KINDS:] = np.sqrt(hashed / n_words)
    return out


KINDS = 10


@F.arrow_udf(T.BinaryType())
def feature_column(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps on standardised features; returns weights in raw units, bias last.

    Rows are standardised a block at a time, so what is held beside x doesn't grow with its rows.
    """
    blocks = [slice(k, k + BLOCK) for k in range(0, len(x), BLOCK)]
    mean = sum(x[b].sum(0, dtype=np.float64) for b in blocks) / len(x)
    scale = np.sqrt(sum(((x[b] - mean) ** 2).sum(0) for b in blocks) / len(x)) + 1e-9
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        grad, hess = ridge * w * len(y) * 0.1, np.eye(len(w)) * ridge * len(y) * 0.1
        for b in blocks:
            z = np.column_stack([(x[b] - mean) / scale, np.ones(len(y[b]))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad += z.T @ (p - y[b])
            hess += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> tuple[list[float], float] | None:
    """Weights and the share of good labels, from at most `sample` labelled documents chosen by a hash of their id."""
    known = labels.where(f"doc_id is not null and {target} is not null").groupBy("doc_id").agg(F.max(target).alias("_y"))
    chosen = known.orderBy(F.xxhash64(F.lit("fit"), "doc_id")).limit(sample)
    rows = documents.select("doc_id", whole_text().alias("_t")).join(F.broadcast(chosen), "doc_id")
    made = rows.select("doc_id", feature_column(F.col("_t")).alias("x"), "_y")
    one = made.groupBy("doc_id").agg(F.min_by("x", F.xxhash64("x")).alias("x"), F.any_value("_y").alias("_y"))  # ids may repeat
    x, y, n = np.empty((sample, KINDS + BUCKETS), np.float32), np.empty(sample), 0
    for row in one.select("x", "_y").toLocalIterator():  # at most `sample` rows of a kilobyte, a partition at a time
        x[n], y[n] = np.frombuffer(row[0], np.float32), row[1]
        n += 1
    x, y = x[:n], y[:n]
    if not n or y.min() == y.max():
        return None
    w = fit(x, y)
    return [float(v) for v in w], float(y.mean())


def log_odds(weights: list[float], text: Column) -> Column:
    """The classifier's log-odds as a column."""
    slope, bias = np.array(weights[:-1]), weights[-1]

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([float(features(t.as_py()) @ slope) + bias for t in texts], pa.float64())

    # never null; said so lest a null check be pushed down as a second evaluation
    return F.coalesce(scored(text), F.lit(0.0))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LIMITS[0])), F.lit(LIMITS[1]))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, total: str, squares: str, count: str) -> float:
    """Pseudo-count of a Beta prior over group rates, by moments; large where groups hardly differ.

    The spread of the group means is held against what the spread within the groups explains. groups: the
    count, total and sum of squares of each group's chances. Five sums come to the driver.
    """
    n, mean = F.col(count), F.col(total) / F.col(count)
    within = F.greatest(F.lit(0.0), F.col(squares) - n * mean * mean)
    r = groups.where(F.col(count) >= 2).agg(F.sum(total), F.sum(n), F.sum(n * mean * mean), F.count("*"), F.sum(within / (n - 1))).first()
    if not r[1] or r[3] < 3:
        return 50.0
    overall = r[0] / r[1]
    between = max(r[2] / r[1] - overall * overall, 0.0) - r[4] / r[1]
    return float(min(1000.0, max(2.0, overall * (1 - overall) / between - 1))) if between > 0 else 1000.0


def site_sums(scored: DataFrame, host: str = "_host", path: str = "_path", p: str = "_p") -> tuple[DataFrame, float, float, float]:
    """Sums of chances by path with those of its host (_s, _n, _hs, _hn), the global rate, and the strengths for hosts and paths."""
    sums = [F.sum(p).alias("_s"), F.count("*").alias("_n"), F.sum(F.col(p) * F.col(p)).alias("_q")]
    paths = stage(scored.groupBy(host, path).agg(*sums), "paths")
    hosts = paths.groupBy(host).agg(F.sum("_s").alias("_hs"), F.sum("_n").alias("_hn"), F.sum("_q").alias("_hq"))
    total = paths.agg(F.coalesce(F.sum("_s"), F.lit(0.0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    overall = total[0] / total[1] if total[1] else 0.5
    found = paths.join(hosts.drop("_hq"), host).select(host, path, "_s", "_n", "_hs", "_hn")
    return found, overall, strength(hosts, "_hs", "_hq", "_hn"), strength(paths, "_s", "_q", "_n")


def without_own(p: Column, overall: float, k_host: float, k_path: float) -> tuple[Column, Column]:
    """Rates of a document's host and path from the sums without its own chance p, shrunk toward the rate above."""
    host = (F.col("_hs") - p + k_host * overall) / (F.col("_hn") - 1 + k_host)
    return host, (F.col("_s") - p + k_path * host) / (F.col("_n") - 1 + k_path)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """The first step of a URL's path, as a section of its site."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^/?#]*)", 1)


def _sited(documents: DataFrame, host: Column, path: Column) -> DataFrame:
    none = F.lit("(none)")
    return documents.withColumns({"_host": F.coalesce(host.cast("string"), none), "_path": F.coalesce(path.cast("string"), none)})


def classify(documents: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with _log_odds, _host_rate, _rate, _score and _keep; columns of these names are replaced.

    host and path: columns that name the site and the section of a document (default: source and lang; for tables
    with a URL url_host and url_path of it).
    The sites' table is small and joined at its size; texts are read twice rather than shuffled.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = train(documents, labels, target)
    rows = _sited(documents.drop("_log_odds", "_host_rate", "_rate", "_score", "_keep", "_s", "_n", "_hs", "_hn"), host, path)
    if model is None:
        zero = F.lit(0.0)
        return rows.withColumns({"_log_odds": zero, "_host_rate": zero + 0.5, "_rate": zero + 0.5, "_score": zero + 0.5, "_keep": F.lit(True)})
    weights, prior = model
    rows = rows.withColumn("_log_odds", log_odds(weights, whole_text()))
    chance = 1 / (1 + F.exp(-F.col("_log_odds")))
    sums, *fitted = site_sums(rows.select("_host", "_path", chance.alias("_p")))
    sums = stage(sums, "sites")
    host_rate, path_rate = without_own(chance, *fitted)
    joined = rows.join(sums, ["_host", "_path"]).withColumns({"_host_rate": host_rate, "_rate": path_rate}).drop("_s", "_n", "_hs", "_hn")
    told = F.col("_log_odds") - F.lit(math.log(prior / (1 - prior))) + _logit(F.col("_rate"))
    return joined.withColumn("_score", 1 / (1 + F.exp(-told))).withColumn("_keep", F.col("_score") >= threshold)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, kept: one row per document."""
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        "doc_id",
        F.round("_log_odds", 6).alias("evidence"),
        F.round("_host_rate", 6).alias("host_rate"),
        F.round("_rate", 6).alias("path_rate"),
        F.round("_score", 6).alias("score"),
        F.col("_keep").alias("kept"),
    )
