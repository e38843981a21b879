"""Store clusters, regional price floors, availability gaps, regions and delivered cost."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EARTH_RADIUS_MILES, ROAD_FACTOR, finite, haversine_miles, r4, round_trip_gas_cost
from ..functions.text import slug
from ..plans.staging import staged
from .graph import components
from .tally import Tally, watched

RADIUS_MILES = 10.0
MIN_REGION_STORES = 2
BLOCK = 1000


def pairs_within(places: DataFrame, radius: float = RADIUS_MILES) -> DataFrame:
    """(a, b, miles), a < b, of places at most `radius` apart. places: dispensary_id, lat, lng.

    Places meet through a grid whose cells are at least the radius wide at the data's highest latitude:
    an equi-join with the nine cells around, not a cross join. Places of a crowded cell are dealt into blocks and every
    block of the one side meets every block of the other, so a task holds some blocks and never a whole cell.
    """
    located = places.where(finite(F.col("lat")) & finite(F.col("lng"))).select("dispensary_id", "lat", "lng")
    top = located.agg(F.max(F.abs("lat"))).first()[0]
    high = min(89.0, (top or 0.0) + 1.0)
    step_lat = math.degrees(radius / EARTH_RADIUS_MILES)
    step_lng = step_lat / math.cos(math.radians(high))
    row, column = F.floor(F.col("lat") / step_lat), F.floor(F.col("lng") / step_lng)
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    left = located.select(F.col("dispensary_id").alias("a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), row.alias("r"), column.alias("c"))
    right = located.select(F.col("dispensary_id").alias("b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"), row.alias("r"), column.alias("c"))
    right = right.withColumn("_dr", F.explode(near)).withColumn("_dc", F.explode(near))
    right = right.withColumn("r", F.col("r") + F.col("_dr")).withColumn("c", F.col("c") + F.col("_dc")).drop("_dr", "_dc")
    miles = haversine_miles(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    blocks = staged(right.groupBy("r", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")), "blocks")
    of = lambda place: F.pmod(F.xxhash64(place), F.col("_n").cast("long")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = left.join(blocks, ["r", "c"]).withColumn("i", of("a")).withColumn("j", each).drop("_n")
    right = right.join(blocks, ["r", "c"]).withColumn("j", of("b")).withColumn("i", each).drop("_n")
    tile = ["r", "c", "i", "j"]
    # both by number, as few bytes make many pairs
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(n, *tile), right.repartition(n, *tile)
    return left.join(right, tile).where("a < b").select("a", "b", miles.alias("miles")).where(F.col("miles") <= radius)


def clusters(places: DataFrame, radius: float = RADIUS_MILES) -> DataFrame:
    """cluster_id (its smallest store) and dispensary_id: single linkage, lone stores included.

    Stores of a grid cell whose diagonal is within the radius are linked whatever their number, so a cell is one node
    and only cells are linked: a dense city costs its cells and not its pairs.
    """
    located = staged(places.where(finite(F.col("lat")) & finite(F.col("lng"))).select("dispensary_id", "lat", "lng"), "located")
    celled = staged(_celled(located, radius), "celled")
    linked = components(_cell_links(celled, radius))
    heads = celled.groupBy("r", "c").agg(F.min("dispensary_id").alias("head")).join(linked, F.col("head") == F.col("node"), "left")
    heads = heads.select("r", "c", F.coalesce("component", "head").alias("cluster_id"))
    return celled.join(heads, ["r", "c"]).select("cluster_id", "dispensary_id", "lat", "lng")


def _celled(located: DataFrame, radius: float) -> DataFrame:
    """Add r, c: cells no wider than radius / sqrt(2) either way, at the latitude where a degree is longest; and reach, how
    many columns away a store within the radius may be, at the one where it is shortest."""
    low, high = located.agg(F.min(F.abs("lat")), F.max(F.abs("lat"))).first()
    side = 0.99 * math.degrees(radius / EARTH_RADIUS_MILES) / math.sqrt(2)
    column = side / max(math.cos(math.radians(min(89.0, low or 0.0))), 1e-3)
    widest = math.degrees(radius / EARTH_RADIUS_MILES) / math.cos(math.radians(min(89.0, (high or 0.0) + 0.5)))
    return located.select("*", F.floor(F.col("lat") / side).alias("r"), F.floor(F.col("lng") / column).alias("c"), F.lit(math.ceil(widest / column)).alias("reach"))


def _cell_links(celled: DataFrame, radius: float) -> DataFrame:
    """(a, b): smallest stores of neighbouring cells that hold two stores within the radius of each other.

    Cells meet through their eight outermost stores first; most are linked by these. Of the others only the stores that
    the other cell's bounds leave within reach are compared, and nothing is kept of them but that there are some.
    """
    corners = [F.col("lat"), F.col("lng"), F.col("lat") + F.col("lng"), F.col("lat") - F.col("lng")]
    outer = [f(F.struct("lat", "lng"), x) for x in corners for f in (F.min_by, F.max_by)]
    bounds = [F.min("lat").alias("low"), F.max("lat").alias("top"), F.min("lng").alias("left"), F.max("lng").alias("right")]
    cells = staged(celled.groupBy("r", "c").agg(F.min("dispensary_id").alias("head"), F.max("reach").alias("reach"), F.array_distinct(F.array(*outer)).alias("outer"), *bounds), "cells")
    rows = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    around = cells.withColumn("_dr", rows).withColumn("_dc", F.explode(F.sequence(-F.col("reach"), F.col("reach"))))
    theirs = around.select((F.col("r") + F.col("_dr")).alias("r"), (F.col("c") + F.col("_dc")).alias("c"), F.struct("head", "outer", *["low", "top", "left", "right"], F.col("r"), F.col("c")).alias("y"))
    met = cells.join(theirs, ["r", "c"]).where("head < y.head")
    miles = lambda p, q: haversine_miles(p["lat"], p["lng"], q["lat"], q["lng"])
    near = F.exists("outer", lambda p: F.exists("y.outer", lambda q: miles(p, q) <= radius))
    met = staged(met.withColumn("near", near), "met")
    step = F.degrees(F.lit(radius / EARTH_RADIUS_MILES)) * 1.01
    wide = step / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("top"), F.abs("low"), F.abs("y.top"), F.abs("y.low")) + 0.5)))
    open_ = met.where("not near").withColumns({"step": step, "wide": wide})
    own = open_.join(celled.select("r", "c", F.struct("lat", "lng").alias("p")), ["r", "c"])
    within = lambda p, o: p["lat"].between(o("low") - F.col("step"), o("top") + F.col("step")) & p["lng"].between(o("left") - F.col("wide"), o("right") + F.col("wide"))
    own = own.where(within(F.col("p"), lambda n: F.col(f"y.{n}"))).select("head", "y", "p", *["low", "top", "left", "right", "step", "wide"])
    other = celled.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.struct("lat", "lng").alias("q"))
    both = own.join(other, (F.col("y.r") == F.col("_r")) & (F.col("y.c") == F.col("_c"))).where(within(F.col("q"), F.col))
    found = both.where(miles(F.col("p"), F.col("q")) <= radius).select("head", F.col("y.head").alias("b")).distinct()
    return met.where("near").select(F.col("head").alias("a"), F.col("y.head").alias("b")).unionByName(found.select(F.col("head").alias("a"), "b"))


def present_places(presence: DataFrame, places: DataFrame, tally: Tally | None = None) -> DataFrame:
    """The located stores of those that carry something. Counted on the way: stores with a place and without."""
    located = F.coalesce(finite(F.col("lat")) & finite(F.col("lng")), F.lit(False))
    carrying = presence.select("dispensary_id").distinct().join(places.select("dispensary_id", "lat", "lng"), "dispensary_id", "left")
    return watched(tally, carrying, clustered_stores=F.count_if(located), unclustered_stores=F.count_if(~located)).where(located)


def centroids(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("store_count"), r4(F.avg("lat")).alias("centroid_lat"), r4(F.avg("lng")).alias("centroid_lng")
    )


def floors(offers: DataFrame, members: DataFrame) -> DataFrame:
    """The lowest price of each cell in each cluster with every store that has it. offers: one row per cell and store."""
    inside = offers.join(members.select("cluster_id", "dispensary_id"), "dispensary_id")
    cell = Window.partitionBy("cluster_id", "match_key", "weight_grams")
    low = inside.withColumn("floor_price", F.min("price").over(cell))
    return low.groupBy("cluster_id", "match_key", "weight_grams", "display_name", "category", "floor_price").agg(
        F.sort_array(F.collect_list(F.when(F.col("price") == F.col("floor_price"), F.col("dispensary_id")))).alias("floor_stores"),
        F.count("*").alias("store_count_in_cluster"),
    )


def gaps(presence: DataFrame, members: DataFrame, status: DataFrame, tally: Tally | None = None) -> DataFrame:
    """(cluster_id, category) carried nowhere in a cluster, for clusters without a suspected extraction failure.

    Counted on the way: clusters, and those whose gaps are suppressed.
    """
    universe = presence.select("category").distinct()
    inside = members.join(status.select("dispensary_id", "status"), "dispensary_id", "left")
    healthy = inside.groupBy("cluster_id").agg(F.max((F.col("status") == "suspected-extraction-failure").cast("int")).alias("bad"))
    healthy = watched(tally, healthy, total_clusters=F.count("*"), suppressed_clusters=F.count_if(F.coalesce("bad", F.lit(0)) == 1))
    wanted = healthy.where("coalesce(bad, 0) = 0").select("cluster_id").crossJoin(F.broadcast(universe))
    present = presence.join(members.select("cluster_id", "dispensary_id"), "dispensary_id").select("cluster_id", "category").distinct()
    return wanted.join(present, ["cluster_id", "category"], "left_anti")


def regions(members: DataFrame, cities: DataFrame) -> DataFrame:
    """Clusters of two stores or more under the name of their commonest city; the first cluster of a slug keeps it."""
    named = members.join(cities.select("dispensary_id", "city"), "dispensary_id", "left")
    counts = named.groupBy("cluster_id", "city").agg(F.count("*").alias("n"))
    label = F.min_by("city", F.struct((-F.col("n")).alias("n"), "city"))
    labels = counts.where("city is not null").groupBy("cluster_id").agg(label.alias("label"))
    sized = members.groupBy("cluster_id").agg(F.count("*").alias("store_count")).where(F.col("store_count") >= MIN_REGION_STORES)
    slugged = sized.join(labels, "cluster_id").withColumn("slug", slug(F.col("label"))).where("slug <> ''")
    first = Window.partitionBy("slug").orderBy("cluster_id")
    return slugged.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def standing_floors(found: DataFrame, status: DataFrame) -> DataFrame:
    """Floors with the holders that are alive; with none alive the floor stays, marked stale."""
    held = found.select("*", F.explode("floor_stores").alias("dispensary_id")).join(status.select("dispensary_id", "status"), "dispensary_id", "left")
    dead = F.coalesce(F.col("status").isin("stale", "failed"), F.lit(False))
    keys = ["cluster_id", "match_key", "weight_grams", "display_name", "category", "floor_price", "store_count_in_cluster"]
    alive = held.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(~dead, F.col("dispensary_id")))).alias("alive"), F.sort_array(F.collect_list("dispensary_id")).alias("held")
    )
    none = F.size("alive") == 0
    return alive.select(*keys, F.when(none, F.col("held")).otherwise(F.col("alive")).alias("floor_stores"), none.alias("stale"))


def delivered(offers: DataFrame, lat: float, lng: float, gas_price: float, mpg: float) -> DataFrame:
    """Cheapest offer of each cell for a user: price plus the gas of the round trip; ties by store."""
    miles = haversine_miles(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) * ROAD_FACTOR
    cost = round_trip_gas_cost(F.col("miles"), F.lit(gas_price), F.lit(mpg))
    priced = offers.withColumn("miles", miles).withColumn("total", F.col("price") + cost).where("total is not null")
    best = F.min(F.struct("total", "dispensary_id", "price", "miles"))
    return priced.groupBy("match_key", "weight_grams").agg(best.alias("o")).select("match_key", "weight_grams", "o.*")


def geo_lookup(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Two registries of places: a secondary entry that does not overlap wins where it is located; unresolved stays null."""
    ours = primary.select("dispensary_id", F.when(finite(F.col("lat")) & finite(F.col("lng")), F.struct("lat", "lng")).alias("own"))
    theirs = secondary.where("not overlap").select(
        "dispensary_id", F.when(finite(F.col("lat")) & finite(F.col("lng")), F.struct("lat", "lng")).alias("other")
    )
    place = F.coalesce("other", "own")
    return ours.join(theirs, "dispensary_id", "full_outer").select("dispensary_id", place["lat"].alias("lat"), place["lng"].alias("lng"))
