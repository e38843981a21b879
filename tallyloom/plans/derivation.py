"""The nightly run: all facts out of inputs that are scanned once, each written in its own envelope.

Observations come as two tables that are staged once: the latest record of every store, product and option, and
one row per series and day. Facts are made in the order of FACTS. A fact reads the inputs or facts written before it in
the run; cells of price gaps are computed once and read back by the five facts that rest on them. What a fact leaves out
is counted in the pass that writes it and stands in its envelope. A fact that fails leaves the others: its row in the
manifest says why, what it wrote before stays current, and the facts that need it fail with it. The manifest has one row
per fact of the run: fact, outcome (written, refused, failed), fact_count, counters, error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import r4
from ..operators import brands, disparity, promotions, regions, series
from ..operators.tally import Tally
from . import envelope
from .staging import drop_staged, staged

MANIFEST = "run string, generated_at string, position int, fact string, outcome string, fact_count long, counters string, error string"
GAP, SHARE = ("arrival", "dormant"), ("below-median", "above-median")


class MissingFact(RuntimeError):
    """A fact of this run that another needs was not written."""


@dataclass
class Run:
    """Inputs of a run and what its facts share.

    records: latest records with match_key, weight_grams and flags; daily: of series.daily_table; places: dispensary_id,
    lat, lng; deals: see promotions; roster: dispensary_id of every store that should be seen, by default those ever seen.
    """

    spark: SparkSession
    root: str
    records: DataFrame
    daily: DataFrame
    places: DataFrame
    deals: DataFrame
    record_day: str
    series_day: str
    max_lag_days: float | None = None
    roster: DataFrame | None = None

    def __post_init__(self) -> None:
        self.written: dict[str, DataFrame] = {}

    def fact(self, name: str) -> DataFrame:
        if name not in self.written:
            raise MissingFact(f"needs {name}, which this run did not write")
        return self.written[name]

    def close(self) -> None:
        """Delete what run_over staged; the facts stay."""
        for table in (self.records, self.daily):
            drop_staged(table)

    @cached_property
    def presence(self) -> DataFrame:
        return staged(self.records.select("dispensary_id", "category").distinct(), "presence")

    @cached_property
    def status(self) -> DataFrame:
        return self.fact("extraction_health").select("dispensary_id", "status")


def by_value(column: str, values: tuple[str, ...]) -> dict:
    return {v.replace("-", "_"): F.count_if(F.col(column) == v) for v in values}


def disparities(run: Run, tally: Tally) -> DataFrame:
    gated = disparity.gated(run.records, run.record_day, run.max_lag_days)
    gates = by_value("reason", ("non-comparable-category", "excluded-flag", "unmatched", "stale"))
    gated = tally.on(gated, total_records=F.count("*"), **gates)
    return tally.on(disparity.disparities(disparity.store_offers(disparity.offers(gated))), disparities=F.count("*"))


def deal_scope(run: Run, tally: Tally) -> DataFrame:
    links = promotions.deal_links(run.deals, run.records)
    linkable = F.col("kind").isin(promotions.LINKED_KINDS)
    kinds = by_value("kind", ("storewide", "category", "brand", "unsupported-category", "unresolved"))
    return tally.on(links, total_deals=F.count("*"), **kinds, zero_match=F.count_if(linkable & (F.col("linked") == 0)), linked_products=F.sum("linked"))


def extraction_health(run: Run, tally: Tally) -> DataFrame:
    roster = run.daily.select("dispensary_id").distinct() if run.roster is None else run.roster
    found = series.extraction_health(run.daily, roster, run.series_day)
    return tally.on(found, total_stores=F.count("*"), **by_value("status", ("ok", "suspected-extraction-failure", "insufficient-history")))


def special_events(run: Run, tally: Tally) -> DataFrame:
    found = series.special_states(run.daily, run.series_day)
    states = by_value("state", ("special-start", "special-end", "unchanged", "gap", "first"))
    return tally.on(found, total_products=F.count("*"), **states).where("state in ('special-start', 'special-end')")


def rollup_category(run: Run, tally: Tally) -> DataFrame:
    return tally.on(disparity.rollup_by_category(run.fact("disparities")), categories=F.count("*"))


def rollup_store(run: Run, tally: Tally) -> DataFrame:
    found = disparity.rollup_by_store(run.fact("disparities"), run.places)
    return tally.on(found, stores=F.count("*"), missing_place=F.count_if(F.col("lat").isNull() | F.col("lng").isNull()))


def brand_personas(run: Run, tally: Tally) -> DataFrame:
    keys = ["dispensary_id", "product_id"]
    until = run.daily.where(F.col("day") <= F.lit(run.series_day).cast("date"))
    products = until.groupBy(*keys).agg(F.max_by("brand", "obs_seq").alias("brand"))
    products = tally.on(products, null_brand_products=F.count_if(brands.brand_key(F.col("brand")).isNull()))
    found = brands.personas(until.select(*keys, "special"), staged(products, "products"))
    kinds = ("always-on-special", "never-discounted", "intermittently-discounted", "insufficient-history")
    return tally.on(found, total_brands=F.count("*"), **by_value("persona", kinds))


def brand_matrix(run: Run, tally: Tally) -> DataFrame:
    return brands.store_matrix(run.records, tally)


def brand_cells(run: Run, tally: Tally) -> DataFrame:
    return brands.matrix_cells(run.records, tally)


def arrivals(run: Run, tally: Tally) -> DataFrame:
    found = series.arrivals_and_dormancy(run.daily, run.status, run.series_day)
    outcomes = ("arrival", "onboarding", "present", "suppressed", "dormant", "below-threshold")
    return tally.on(found, total_products=F.count("*"), **by_value("outcome", outcomes)).where(F.col("outcome").isin(*GAP))


def own_median(run: Run, tally: Tally) -> DataFrame:
    day = F.lit(run.series_day).cast("date")
    inside = (F.col("day") >= F.date_sub(day, series.MEDIAN_DAYS - 1)) & (F.col("day") <= day)
    counted = tally.on(run.daily, no_usable_price=F.sum(F.when(inside, F.col("unusable")).otherwise(0)))
    found = series.own_median(counted, ["dispensary_id", "product_id"], run.series_day)
    outcomes = ("below-median", "above-median", "at-median", "below-floor", "no-observation-today")
    return tally.on(found, total_series=F.count("*"), **by_value("outcome", outcomes)).where(F.col("outcome").isin(*SHARE))


def delivered(run: Run, tally: Tally) -> DataFrame:
    cells = tally.on(run.fact("disparities"), total_cells=F.count("*"))
    found = disparity.delivered_offers(cells, run.places)
    missing = F.col("lat").isNull() | F.col("lng").isNull()
    return tally.on(found, store_offers=F.count("*"), offers_with_place=F.count_if(~missing), missing_place=F.count_if(missing))


def region_members(run: Run, tally: Tally) -> DataFrame:
    located = staged(regions.present_places(run.presence, run.places, tally), "located")
    return tally.on(regions.clusters(located), members=F.count("*"))


def region_floors(run: Run, tally: Tally) -> DataFrame:
    flat = disparity.flat_offers(run.fact("disparities")).select("match_key", "weight_grams", "display_name", "category", "dispensary_id", "price")
    found = regions.floors(flat, run.fact("region_members"))
    return tally.on(found, total_floors=F.count("*"), single_store_floors=F.count_if(F.col("store_count_in_cluster") == 1))


def region_gaps(run: Run, tally: Tally) -> DataFrame:
    return regions.gaps(run.presence, run.fact("region_members"), run.status, tally)


Fact = Callable[[Run, Tally], DataFrame]
FACTS: dict[str, Fact] = {
    "disparities": disparities,
    "deal_scope": deal_scope,
    "extraction_health": extraction_health,
    "special_events": special_events,
    "rollup_category": rollup_category,
    "rollup_store": rollup_store,
    "brand_personas": brand_personas,
    "brand_matrix": brand_matrix,
    "brand_cells": brand_cells,
    "arrivals": arrivals,
    "own_median": own_median,
    "delivered": delivered,
    "region_members": region_members,
    "region_floors": region_floors,
    "region_gaps": region_gaps,
}


def derive(run: Run, generated_at: str, facts: dict[str, Fact] = FACTS) -> DataFrame:
    """Write the facts below run.root and return the run's manifest, which is kept there too.

    Stops before anything is written if there are no records while the current gaps rest on some: the input is wrong.
    """
    spark, name = run.spark, uuid.uuid4().hex
    before = json.loads(envelope.read_envelope(spark, f"{run.root}/disparities").first()["counters"])
    if before.get("total_records") and not run.records.take(1):
        raise ValueError(f"no records, but the current facts in {run.root} rest on {before['total_records']}: not overwritten")
    told = []
    for position, (fact, make) in enumerate(facts.items()):
        tally, path = Tally(), f"{run.root}/{fact}"
        try:
            made = make(run, tally)
            kept = envelope.write_fact(made, tally.counts, path, generated_at)
            if kept:
                run.written[fact] = envelope.read_facts(spark, path, made.schema)
            now = envelope.read_envelope(spark, path).first()
            told.append((name, generated_at, position, fact, "written" if kept else "refused", now["fact_count"], now["counters"], None))
        except Exception as error:  # any failure of one fact must leave the others
            told.append((name, generated_at, position, fact, "failed", None, None, f"{type(error).__name__}: {error}"[:500]))
    if "presence" in run.__dict__:
        drop_staged(run.presence)
    manifest = spark.createDataFrame(told, MANIFEST)
    manifest.coalesce(1).write.json(f"{run.root}/manifest/{name}")
    return manifest


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all runs below root."""
    return envelope.lines(spark, f"{root}/manifest", MANIFEST) if envelope.exists(spark, f"{root}/manifest") else spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, root: str, fact: str, like: DataFrame) -> DataFrame:
    """The current rows of a fact; `like` has its columns."""
    return envelope.read_facts(spark, f"{root}/{fact}", like.schema)


def run_over(spark: SparkSession, root: str, observed: DataFrame, watched: DataFrame, **inputs) -> Run:
    """A run over latest records and raw daily observations; both are scanned once, here."""
    return Run(spark, root, records=staged(observed, "records"), daily=staged(series.daily_table(watched), "daily"), **inputs)
