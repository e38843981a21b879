"""Queries over landed payloads: bodies, pages, feeds and lists made of the test tables, then parsed; and facts written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapter, payloads
from . import envelope
from .staging import shared_dir

PER_PAGE = 50
IDS = 150


def _grouped(rows: DataFrame, page: Column, item: Column, order: str) -> DataFrame:
    """page_seq and the page's items in order. A page holds few items by nature."""
    return rows.groupBy(page.alias("page_seq")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, item.alias("item")))), lambda x: x["item"]).alias("items"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Parts with their category, the page that lists a part, and its id, which comes back on later pages."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").join(adapter.catalog(spark, sf_dir).select("partkey", "category"), F.col("p_partkey") == F.col("partkey"))
    return p, F.floor(F.col("p_partkey") / PER_PAGE), F.concat(F.lit("p"), (F.col("p_partkey") % IDS).cast("string"))


def src8_product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products out of JSON bodies, the first of each id."""
    p, page, made_id = _parts(spark, sf_dir)
    size, price = F.concat(F.col("p_size").cast("string"), F.lit("g")), F.col("p_retailprice")
    child = F.struct(size.alias("option"), price.alias("price"), F.lit(3.0).alias("quantityAvailable"))
    high = F.when(F.col("p_partkey") % 5 == 0, -1.0).otherwise(20.0 + F.col("p_partkey") % 3)
    item = F.struct(
        made_id.alias("_id"),
        F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   "))).alias("Name"),
        F.col("category").alias("type"),
        F.col("p_brand").alias("brandName"),
        (F.col("p_partkey") % 2 == 0).alias("special"),
        F.array(size, F.lit("99g")).alias("Options"),
        F.array(price / 2).alias("recSpecialPrices"),
        F.struct(F.lit("%").alias("unit"), F.array(high, F.lit(18.0)).alias("range")).alias("THCContent"),
        F.struct(F.array(child).alias("children")).alias("POSMetaData"),
    )
    pages = _grouped(p, page, item, "p_partkey")
    body = F.to_json(F.struct(F.struct(F.struct(F.col("items").alias("products")).alias("filteredProducts")).alias("data")))
    landed = pages.select(F.when(F.col("page_seq") % 7 == 3, "u/other").otherwise("u/FilteredProducts").alias("url"), "page_seq", F.when(F.col("page_seq") % 7 == 5, "{").otherwise(body).alias("body"))
    out = payloads.raw_products(payloads.product_pages(landed), ["Flower", "Edible"])
    first, second = F.col("options")[0], F.col("options")[1]
    return out.select(
        "product_id", "name", "category", "brand", "special", first["option"].alias("option"), first["base_price"].alias("base_price"), first["special_price"].alias("special_price"),
        second["base_price"].alias("other_price"), F.col("thc.low").alias("thc_low"), F.col("thc.high").alias("thc_high"),
    )


def src12_menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products out of the JSON within HTML pages, listed at either of two places."""
    p, page, _ = _parts(spark, sf_dir)
    gear = F.col("p_partkey") % 3 == 0
    price = F.struct(F.lit("1g").alias("label"), (F.col("p_retailprice") / 2).alias("price"), F.col("p_retailprice").alias("originalPrice"), (F.col("p_partkey") % 2 == 0).alias("onSale"))
    item = F.struct(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-cart-"), (F.col("p_partkey") % IDS).cast("string")).alias("slug"),
        F.concat("p_name", F.lit(" | 1g")).alias("name"),
        F.struct(F.when(gear, "Gear").otherwise("Vape carts").alias("name"), F.when(gear, "gear").otherwise("cart").alias("slug")).alias("edgeCategory"),
        F.struct(F.array(price).alias("gram")).alias("prices"),
    )
    pages = _grouped(p, page, item, "p_partkey")
    inner = F.to_json(F.struct(F.col("items").alias("menuItems")))
    held = F.when(F.col("page_seq") % 2 == 0, F.concat(F.lit('{"data":'), inner, F.lit("}"))).otherwise(inner)
    text = F.concat(F.lit('{"props":{"dehydratedState":{"queries":[{"state":{"data":'), held, F.lit("}}]}}}"))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), text, F.lit("</script></html>"))
    out = payloads.menu_products(payloads.menu_items(pages.select("page_seq", html.alias("html"))))
    first = F.col("options")[0]
    return out.select("product_id", "name", "category", "brand", first["base_price"].alias("base_price"), first["special_price"].alias("special_price"), "special")


def src21_card_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals out of the cards of HTML pages."""
    p, page, _ = _parts(spark, sf_dir)
    n, pct = F.col("p_partkey"), (F.col("p_size") + 1).cast("string")
    told = F.when(n % 3 == 0, F.concat(F.lit("<p>7-8am "), pct, F.lit("% OFF</p>"))).when(n % 3 == 1, F.concat(F.lit("<p>"), pct, F.lit("% off &amp; more, tuesday</p>"))).otherwise("<p>no deal</p>")
    card = F.concat(F.lit('<li class="el-item"><h3>'), F.col("p_name"), F.lit("</h3>"), told, F.lit("</li>"))
    pages = _grouped(p, page, card, "p_partkey").select(F.col("page_seq").alias("page_id"), F.concat(F.lit("<ul>"), F.array_join("items", "\n"), F.lit("</ul>")).alias("html"))
    out = payloads.card_deals(pages, r"(?s)<li class=\"el-item\">.*?</li>")
    return out.withColumn("days_valid", F.array_join("days_valid", ","))


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.col("conv_id")


def src45_feed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of JSON listings, those with an id."""
    c, page = _turns(spark, sf_dir)
    post_id = F.when(F.col("turn") % 4 == 3, "").when(F.col("turn") % 4 != 2, F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn"))
    item = F.struct(F.struct(post_id.alias("id"), F.col("role").alias("title"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("selftext")).alias("data"))
    body = F.to_json(F.struct(F.struct(F.col("items").alias("children")).alias("data")))
    posts = payloads.feed_posts(_grouped(c, page, item, "turn").select(body.alias("body")))
    return posts.select("id", "title", F.md5(F.col("selftext").cast("binary")).alias("text_md5"), "permalink")


def src47_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of XML feeds, texts decoded twice."""
    c, page = _turns(spark, sf_dir)
    entry_id = F.when(F.col("turn") % 3 == 2, "t1_x").otherwise(F.concat(F.lit("t3_c"), "conv_id", F.lit("t"), "turn"))
    item = F.concat(
        F.lit("<entry><id>"), entry_id, F.lit("</id><title>Turn &amp;amp; "), F.col("role"), F.lit("</title><content type=\"html\">&lt;p&gt;said  by&lt;/p&gt; "), F.col("turn").cast("string"), F.lit("</content></entry>")
    )
    bodies = _grouped(c, page, item, "turn").select(F.concat(F.lit("<feed>"), F.array_join("items", ""), F.lit("</feed>")).alias("body"))
    return payloads.feed_entries(bodies)


def src48_first_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of a list in any of three separators."""
    n = F.col("page_id")
    sep = F.when(n % 3 == 0, ",").when(n % 3 == 1, ";").otherwise("\t")
    lines = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(n.cast("string"), sep, F.lit('"'), F.col("url"), F.lit('"'), sep, F.lit("late.example")).alias("value"))
    return payloads.first_domains(lines)


def snk1_fact_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written twice and then refused, as a write of none would lose them; what stands is read back with its envelope."""
    path = f"{shared_dir(spark)}/tallyloom/fact-{uuid.uuid4().hex}"
    c = adapter.catalog(spark, sf_dir).select("product_id", "category")
    for at, rows in (("2026-01-01", c.where("category = 'Edible'")), ("2026-01-02", c.where("category = 'Flower'")), ("2026-01-03", c.where("false"))):
        envelope.write_fact(rows, rows.agg(F.count("*").alias("total")), path, at)
    told = envelope.read_envelope(spark, path).select("generated_at", "fact_count", "counters")
    return envelope.read_facts(spark, path, "product_id string, category string").crossJoin(F.broadcast(told))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
