"""Personal data by weak supervision (DataFrame functions only).

Candidate spans come from strict and loose patterns; loose ones are spelled-out or split addresses,
IPv6, cards with other separators, national and 00-prefixed phones, and secrets (tokens, keys). Labelers
vote on each: its form (checksum, shape, digit count), a gazetteer of known domains, prefixes and codes,
words for and against in the context, and the characters at the edges. Expectation-maximisation over the
table of vote patterns, whose size depends on the labelers alone, estimates how reliable each labeler is
per kind; its posteriors are the soft labels from which grouped sums train a naive-Bayes span classifier
on votes, length, digits, shape and the neighbouring word. Strict spans always stay; loose ones are added
where the classifier gives them more than even odds and they overlap no strict span and no added one
that is listed before.

Defined cases: a null text counts as empty; texts without spans give zero counts, empty `spans` and the
digest of the empty string; repeated rows give repeated results; with no candidates at all nothing is
trained and nothing added. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, whole_text

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]  # kinds with a strict pattern

#: Strict patterns. They find what the plain forms
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card  [0-9]([\x20-]?[0-9])+                                 phone \+[0-9][\x20().0-9-]+[0-9]
#: find, without backtracking into a run that has failed once: a run can only match from its start or
#: from the end of the last match. Card runs of under 12 digits, which fail the check, are not cut out.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose patterns, whose spans are added only if the classifier believes them.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.| \. )[A-Za-z0-9-]{2,63}+)+| at [A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]{2,63}+)+)",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])(?:[0-9]{4}(?:[./_][0-9]{4}){3}|3[47][0-9]{2}[./_][0-9]{6}[./_][0-9]{5})(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}|00[1-9][0-9]{8,12})(?![0-9A-Za-z]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9_./@#-])(?=[A-Za-z_-]{0,64}+[0-9])[A-Za-z0-9_-]{20,}+",
}
FOR = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|address|courriel|correo|from|to)\W{0,4}$",
    "ip": r"(?i)(?:\bip\b|ipv6|address|host|server|from|client|peer|adresse)\W{0,4}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta|number|no)\W{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|dial|contact|telefon|t.l.phone|tel.fono)\W{0,4}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|passphrase|key|bearer|auth|authorization|credentials?)\W{0,5}$",
}
_NUMBERED = r"(?i)(?:version|\bv|release|token|key|hash|id|isbn|section|licen[cs]e|sha|md5)\W{0,4}$"
AGAINST = {kind: _NUMBERED for kind in BASE} | {
    "secret": r"(?i)(?:commit|sha-?[0-9]{0,3}|md5|hash|checksum|digest|etag|\bid|uuid|revision|version|file|image)\W{0,5}$"
}
GAZETTEER = {
    "email": r"(?i)(?:\. ?|dot |\(dot\) ?|\[dot\] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|example|test)$",
    "ip": r"^(?:10|127|172|192|198|203)\.|^(?i:fe80|fd|20)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2}\)?[ .-])",
    "secret": r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|pk[-_]|eyJ)",
}
VOTERS = ("form", "gazetteer", "context", "edges")
ROUNDS = 50


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(i % 2 == 0, twice(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int")
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = "^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
        return F.forall(F.split(value, "\\."), lambda part: part.rlike(small))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(value)).otherwise(False)
    return (n >= 9) & (n <= 15)


BLOCK = 128


SPANS = "array<struct<start:int,kind_no:int,end:int,strict:boolean,value:string,before:string,after:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def _spans(kind: str, strict: bool) -> Column:
    """Spans of one pattern: array of (start, kind_no, end, strict, value, before, after).

    Offsets are sums of the lengths of matches and of the pieces between them, so the text is searched
    twice and no more; sums are kept by blocks of matches, so that a text with very many stays cheap.
    """
    pattern = (STRICT if strict else LOOSE)[kind]
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, v: a + v)

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda x: F.length(x["p"]) + F.length(x["m"]))
        return _let(lengths, lambda n: _let(sums(n), lambda b: F.transform(parts, lambda x, k: span(x, k, n, b))))

    def sums(lengths: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK))
        each = F.transform(starts, lambda k: total(F.slice(lengths, k + 1, F.lit(BLOCK))))
        return _let(each, lambda e: F.transform(e, lambda v, k: total(F.slice(e, F.lit(1), k))))

    def span(x: Column, k: Column, lengths: Column, blocks: Column) -> Column:
        block = F.floor(k / BLOCK).cast("int")
        before = F.get(blocks, block) + total(F.slice(lengths, block * BLOCK + 1, k - block * BLOCK))
        start = before + F.length(x["p"])
        return F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind_no"),
            (start + F.length(x["m"])).alias("end"),
            F.lit(strict).alias("strict"),
            x["m"].alias("value"),
            F.right(x["p"], F.lit(24)).alias("before"),
            F.left(x["q"], F.lit(4)).alias("after"),
        )

    def zipped(matches: Column) -> Column:
        part = lambda p, m, q: F.struct(p.alias("p"), m.alias("m"), q.alias("q"))
        pieces = F.split("text", pattern, -1)
        found = _let(pieces, lambda p: F.transform(matches, lambda m, k: part(F.get(p, k), m, F.get(p, k + 1))))
        kept = _let(found, placed)
        return F.filter(kept, lambda s: _valid(kind, s["value"])) if strict or kind == "card" else kept

    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return _let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(SPANS)).otherwise(zipped(m)))


def _per_kind(kind_no: Column, by_kind) -> Column:
    return reduce(lambda rest, k: F.when(kind_no == k, by_kind(KINDS[k])).otherwise(rest), range(len(KINDS)), F.lit(0))


def _form(kind: str, value: Column) -> Column:
    """Whether a value is made as its kind is: 1 for, -1 against, 0 where that cannot be told."""
    n = F.length(_digits(value))
    if kind == "email":
        return F.when(value.rlike(r"[A-Za-z]{2,24}$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(value.rlike(r"^[0-9](?:\.[0-9]){3}$|^0|^(?:24|25)[0-9]\."), -1).when(value.contains("::") & ~value.rlike("[0-9A-Fa-f]{3}"), 0).otherwise(1)
    if kind == "card":
        return F.when(F.when((n >= 12) & (n <= 19), _luhn(value)).otherwise(False), 1).otherwise(-1)
    if kind == "phone":
        return F.when((n >= 10) & (n <= 13), 1).when((n >= 7) & (n <= 15), 0).otherwise(-1)
    mixed = value.rlike(r"(?:[0-9][^0-9]+){3}|[0-9]{6}") & value.rlike(r"[A-Za-z]")
    return F.when(value.rlike(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$") | ~value.rlike("[-]") & mixed, 1).when(mixed, 0).otherwise(-1)


def _voted(span: Column) -> Column:
    """The span without its strings: offsets, votes of -1, 0 or 1, and the classifier's features, whose values are bounded in number."""
    value, before, after = span["value"], span["before"], span["after"]
    kind = span["kind_no"]
    form = _per_kind(kind, lambda k: _form(k, value))
    gazetteer = _per_kind(kind, lambda k: F.when(value.rlike(GAZETTEER[k]), 1).otherwise(0))
    context = _per_kind(kind, lambda k: F.when(before.rlike(AGAINST[k]), -1).when(before.rlike(FOR[k]), 1).otherwise(0))
    glued = F.when(before.rlike(r"[A-Za-z0-9_=/\"]$") | after.rlike(r"^[A-Za-z0-9_=/\"]"), -1).otherwise(1)
    quoted = F.when(before.rlike("[=:] ?[\"'`]?$|[\"'`]$"), 1).when(after.rlike(r"^[./@]"), -1).otherwise(0)
    edges = F.when(kind == KINDS.index("secret"), quoted).otherwise(glued)
    votes = F.array(form, gazetteer, context, edges)
    side = lambda s, p: F.when(s.rlike(p), "word").when(F.length(s) == 0, "none").otherwise("other")
    bucket = lambda s, n: F.pmod(F.xxhash64(s), F.lit(n)).cast("string")
    shape = F.left(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a"), F.lit(10))
    features = F.array(
        F.concat(F.lit("length="), F.least(F.floor(F.length(value) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("digits="), F.floor(F.length(_digits(value)) * 4 / F.length(value)).cast("string")),
        F.concat(F.lit("shape="), bucket(shape, 64)),
        F.concat(F.lit("word="), bucket(F.lower(F.regexp_extract(before, r"(\w+)\W*$", 1)), 256)),
        F.concat(F.lit("before="), side(before, r"[\w]\W?$")),
        F.concat(F.lit("after="), side(after, r"^\W?[\w]")),
        *[F.concat(F.lit(f"{name}="), vote.cast("string")) for name, vote in zip(VOTERS, (form, gazetteer, context, edges))],
    )
    return F.struct(
        span["start"].alias("start"),
        kind.alias("kind_no"),
        span["end"].alias("end"),
        span["strict"].alias("strict"),
        votes.alias("votes"),
        features.alias("features"),
    )


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, spans: every strict and loose span with votes and features, without text."""
    rows = documents.select("doc_id", whole_text().alias("text"))
    strict, loose = [f"{k}_strict" for k in BASE], [f"{k}_loose" for k in KINDS]
    rows = rows.select("doc_id", *[_spans(k, True).alias(f"{k}_strict") for k in BASE], *[_spans(k, False).alias(f"{k}_loose") for k in KINDS])
    # a loose span that overlaps a strict one says nothing new
    rows = rows.withColumn("_strict", F.concat(*strict))
    apart = lambda a: ~F.exists("_strict", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))
    rows = rows.select("doc_id", *strict, *[F.filter(n, apart).alias(n) for n in loose])
    return rows.select("doc_id", F.transform(F.concat(*strict, *loose), _voted).alias("spans"))


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, count) rows: the chance that a span voted so is personal data.

    A labeler's table holds P(vote | class), with a prior that voting for a span is right more often than not.
    """
    posterior: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        belief = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in rows}
        for _ in range(rounds):
            prior = (1 + sum(n * belief[v] for v, n in rows)) / (2 + sum(n for _, n in rows))
            tables = []
            for j in range(len(VOTERS)):
                table = {}
                for c in (0, 1):
                    agree = 2 * c - 1
                    weight = {x: (4.0 if x == agree else 2.0 if x == 0 else 1.0) for x in (-1, 0, 1)}
                    for v, n in rows:
                        weight[v[j]] += n * (belief[v] if c else 1 - belief[v])
                    total = sum(weight.values())
                    table[c] = {x: w / total for x, w in weight.items()}
                tables.append(table)
            was = belief
            belief = {}
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(t[1][x] / t[0][x]) for t, x in zip(tables, v))
                belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            if max(abs(belief[v] - was[v]) for v in belief) < 1e-9:
                break
        posterior |= {(kind, v): p for v, p in belief.items()}
    return posterior


def _doubles(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])


def train(found: DataFrame) -> dict[str, float]:
    """Log-odds by "kind|feature" from the soft labels of the vote patterns, and "kind|" for the prior.

    Two grouped counts come to the driver; their sizes are set by the labelers and feature values.
    """
    spans = found.select(F.explode("spans").alias("s")).select("s.kind_no", "s.votes", "s.features")
    counted = spans.groupBy("kind_no", "votes").count().collect()
    if not counted:
        return {}
    posterior = estimate([(r[0], tuple(r[1]), r[2]) for r in counted])
    believed = _doubles({f"{k}|" + ",".join(map(str, v)): p for (k, v), p in posterior.items()})
    pattern = F.concat_ws("|", F.col("kind_no").cast("string"), F.array_join(F.col("votes").cast("array<string>"), ","))
    soft = spans.select("kind_no", F.explode(F.concat("features", F.array(F.lit("")))).alias("f"), F.element_at(believed, pattern).alias("p"))
    sums = soft.groupBy("kind_no", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    whole = {r[0]: (r[2], r[3]) for r in sums if r[1] == ""}
    odds = {}
    for kind, feature, yes, no in sums:
        if feature:
            odds[f"{kind}|{feature}"] = math.log((yes + 1) / (whole[kind][0] + 2)) - math.log((no + 1) / (whole[kind][1] + 2))
        else:
            odds[f"{kind}|"] = math.log((yes + 1) / (no + 1))
    return odds


def find_private(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (strict spans), base_sha256, spans, n_secret, n_added, n_spans (all of them)."""
    found = stage(candidates(documents), "candidates")
    odds = train(found)
    if odds:
        table = _doubles(odds)
        score = lambda s: F.aggregate(
            s["features"],
            F.element_at(table, F.concat(s["kind_no"].cast("string"), F.lit("|"))),
            lambda a, f: a + F.coalesce(F.element_at(table, F.concat(s["kind_no"].cast("string"), F.lit("|"), f)), F.lit(0.0)),
        )
        chosen = F.filter("spans", lambda s: s["strict"] | (score(s) > 0))
    else:
        chosen = F.col("spans")
    plain = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["strict"].alias("strict")))
    rows = found.select("doc_id", F.array_sort(plain).alias("all"))
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind_no"] + 1)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("all", lambda s: s["strict"])
    count = lambda spans: F.size(spans).cast("long")
    return rows.select(
        "doc_id",
        *[count(F.filter(base, lambda s: s["kind_no"] == k)).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("all")).alias("spans"),
        count(F.filter("all", lambda s: s["kind_no"] == KINDS.index("secret"))).alias("n_secret"),
        count(F.filter("all", lambda s: ~s["strict"])).alias("n_added"),
        count(F.col("all")).alias("n_spans"),
    )


def pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
