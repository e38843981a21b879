"""Landed payloads (JSON pages, embedded JSON, HTML cards, feeds, logs) as product, deal and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.deals import DAYS
from ..functions.numbers import finite

# The payload formats and rules that results depend on.
PRODUCT_PAGE = """struct<data:struct<filteredProducts:struct<products:array<struct<
  _id:string,id:string,Name:string,type:string,subcategory:string,brandName:string,strainType:string,special:boolean,weight:double,
  totalTerpenes:double,Options:array<string>,recSpecialPrices:array<double>,effects:map<string,double>,
  THCContent:struct<unit:string,range:array<double>>,CBDContent:struct<unit:string,range:array<double>>,
  measurements:struct<netWeight:struct<unit:string,values:array<double>>>,
  POSMetaData:struct<children:array<struct<option:string,price:double,quantityAvailable:double>>>>>>>>""".replace("\n", "")
MENU_ITEM = """struct<id:string,slug:string,name:string,edgeCategory:struct<name:string,slug:string,ancestors:array<struct<name:string,slug:string>>>,
  prices:map<string,array<struct<label:string,price:double,originalPrice:double,onSale:boolean>>>>""".replace("\n", "")
CATEGORY_RULES = [
    (r"pre[-\s]?roll", "Pre-Rolls"),
    (r"\bedibles?\b", "Edible"),
    (r"vape|vapor|cartridge|\bcart\b|\bpen", "Vaporizers"),
    (r"flower", "Flower"),
    (r"\bconcentrates?\b", "Concentrate"),
]
DAY_WORDS = r"(?i)\b(sunday|monday|tuesday|wednesday|thursday|friday|saturday|sun|mon|tues?|wed|thurs?|fri|sat)\b"
BOUNDS = (45.5, 49.0, -124.85, -116.9)


def product_pages(pages: DataFrame, pattern: str = "(?i)FilteredProducts") -> DataFrame:
    """pages: url, page_seq, body. Raw products of the matching pages, the first of each id; unreadable bodies give none."""
    parsed = pages.where(F.col("url").rlike(pattern)).select("page_seq", F.from_json("body", PRODUCT_PAGE).alias("b"))
    each = parsed.select("page_seq", F.posexplode("b.data.filteredProducts.products").alias("pos", "p"))
    keyed = each.withColumn("product_id", F.coalesce("p._id", "p.id", F.lit(""))).where("product_id <> ''")
    first = Window.partitionBy("product_id").orderBy("page_seq", "pos")
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("product_id", "p")


def potency(raw: Column) -> Column:
    """struct(unit, low, high); null without a unit or with any value that is no number from zero up."""
    bad = F.exists(raw["range"], lambda v: ~F.coalesce(finite(v) & (v >= 0), F.lit(False)))
    unit = F.trim(raw["unit"])
    made = F.struct(unit.alias("unit"), F.array_min(raw["range"]).alias("low"), F.array_max(raw["range"]).alias("high"))
    return F.when((unit != "") & (F.size(raw["range"]) > 0) & ~bad, made)


def effects(raw: Column) -> Column:
    kept = F.map_filter(raw, lambda k, v: F.coalesce(finite(v), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def net_weight_mg(measure: Column) -> Column:
    value, unit = F.get(measure["values"], F.lit(0)), F.upper(measure["unit"])
    return F.when(unit == "MILLIGRAMS", value).when(unit == "GRAMS", value * 1000)


def raw_products(products: DataFrame, categories: list[str]) -> DataFrame:
    """Products of the wanted categories with options: base price by label (the last child wins), special by position."""
    p = F.col("p")
    children = p["POSMetaData"]["children"]
    label = lambda o: F.element_at(F.filter(children, lambda c: c["option"] == o), -1)

    def option(o: Column, i: Column) -> Column:
        child = F.when(F.exists(children, lambda c: c["option"] == o), label(o))
        return F.struct(
            o.alias("option"),
            child["price"].alias("base_price"),
            F.when(p["special"], F.get(p["recSpecialPrices"], i)).alias("special_price"),
            child["quantityAvailable"].alias("quantity_available"),
        )

    name = F.trim(F.regexp_replace(p["Name"], r"\s+", " "))
    wanted = (name != "") & p["type"].isin(categories) & (F.size(p["Options"]) > 0)
    return products.where(wanted).select(
        "product_id",
        name.alias("name"),
        p["type"].alias("category"),
        F.nullif(p["brandName"], F.lit("")).alias("brand"),
        F.nullif(p["strainType"], F.lit("")).alias("strain_type"),
        F.coalesce(p["special"], F.lit(False)).alias("special"),
        p["weight"].alias("weight_field"),
        net_weight_mg(p["measurements"]["netWeight"]).alias("net_weight_mg"),
        potency(p["THCContent"]).alias("thc"),
        potency(p["CBDContent"]).alias("cbd"),
        p["totalTerpenes"].alias("total_terpenes"),
        effects(p["effects"]).alias("effects"),
        F.nullif(F.trim(p["subcategory"]), F.lit("")).alias("subcategory"),
        F.transform(p["Options"], option).alias("options"),
    )


def embedded_json(html: Column, script_id: str = "__NEXT_DATA__") -> Column:
    """The text of a JSON script in a page; null where there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?s)<script[^>]*id=\"{script_id}\"[^>]*>(.*?)</script>", 1), F.lit(""))


def menu_items(pages: DataFrame) -> DataFrame:
    """pages: page_seq, html. Items of the embedded queries, found at either place, the first of each slug or id."""
    shape = f"struct<props:struct<dehydratedState:struct<queries:array<struct<state:struct<data:struct<data:struct<menuItems:array<{MENU_ITEM}>>,menuItems:array<{MENU_ITEM}>>>>>>>>"
    data = pages.select("page_seq", F.from_json(embedded_json(F.col("html")), shape).alias("j"))
    queries = data.select("page_seq", F.posexplode("j.props.dehydratedState.queries").alias("q_pos", "q"))
    each = queries.select("page_seq", "q_pos", F.posexplode(F.coalesce("q.state.data.data.menuItems", "q.state.data.menuItems")).alias("pos", "item"))
    keyed = each.withColumn("item_id", F.coalesce("item.slug", "item.id")).where("item_id is not null")
    first = Window.partitionBy("item_id").orderBy("page_seq", "q_pos", "pos")
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("item_id", "item")


def category_of(text: Column) -> Column:
    """Launch category of a category text; rules in order, null for none."""
    lower = F.lower(text)
    out = F.lit(None).cast("string")
    for pattern, category in reversed(CATEGORY_RULES):
        out = F.when(lower.rlike(pattern), category).otherwise(out)
    return out


def category_text(edge: Column) -> Column:
    above = F.flatten(F.transform(F.coalesce(edge["ancestors"], F.array().cast("array<struct<name:string,slug:string>>")), lambda a: F.array(a["name"], a["slug"])))
    return F.array_join(F.concat(F.array(edge["name"], edge["slug"]), above), " ")


def brand_from_slug(slug: Column, category_token: Column) -> Column:
    """Words of a slug before its category word, one to four, in title case; else null."""
    words = F.filter(F.split(F.lower(slug), "-"), lambda w: w != "")
    head = F.get(F.filter(F.split(F.lower(category_token), r"[-\s]"), lambda w: w != ""), F.lit(0))
    at = F.array_position(words, head)
    return F.when((at >= 2) & (at <= 5), F.array_join(F.transform(F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.initcap), " "))


def price_options(prices: Column) -> Column:
    """Options of a map of price lists, the first of each label: base is the original price, special the sale price."""
    flat = F.flatten(F.map_values(prices))
    labels = F.array_distinct(F.transform(flat, lambda x: x["label"]))
    one = lambda label: F.get(F.filter(flat, lambda x: x["label"] == label), F.lit(0))
    made = lambda x: F.struct(
        x["label"].alias("option"),
        F.coalesce(x["originalPrice"], x["price"]).alias("base_price"),
        F.when(x["onSale"], x["price"]).alias("special_price"),
        F.lit(None).cast("double").alias("quantity_available"),
    )
    return F.transform(F.filter(labels, lambda v: v.isNotNull()), lambda v: made(one(v)))


def head_name(raw: Column) -> Column:
    """A name up to its first pipe, spaces collapsed; the whole name if that leaves nothing."""
    plain = lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.coalesce(F.nullif(plain(F.split_part(raw, F.lit("|"), F.lit(1))), F.lit("")), plain(raw))


def menu_products(items: DataFrame) -> DataFrame:
    item = F.col("item")
    out = items.select(
        F.col("item_id").alias("product_id"),
        head_name(item["name"]).alias("name"),
        category_of(category_text(item["edgeCategory"])).alias("category"),
        brand_from_slug(item["slug"], item["edgeCategory"]["slug"]).alias("brand"),
        price_options(item["prices"]).alias("options"),
    )
    return out.where("category is not null and size(options) > 0").withColumn("special", F.exists("options", lambda o: o["special_price"].isNotNull()))


def weekdays_in(text: Column) -> Column:
    """Weekdays that a text names in whole words, in calendar order; everyday if none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DAY_WORDS), F.lit(1)), lambda w: F.left(F.lower(w), F.lit(3)))
    days = F.filter(F.array(*[F.lit(d) for d in DAYS]), lambda d: F.array_contains(found, F.left(d, F.lit(3))))
    return F.when(F.size(days) > 0, days).otherwise(F.array(F.lit("everyday")))


def weekdays_within(title: Column) -> Column:
    """The looser form: weekdays anywhere in a title."""
    days = F.filter(F.array(*[F.lit(d) for d in DAYS]), lambda d: F.lower(title).contains(d))
    return F.when(F.size(days) > 0, days).otherwise(F.array(F.lit("everyday")))


def stated_percent(name: Column, text: Column) -> Column:
    """First percentage of a card; null where the title states a price and no percentage."""
    pct = lambda s: F.nullif(F.regexp_extract(s, r"([0-9]+)\s*%", 1), F.lit("")).try_cast("int")
    return F.when(name.rlike(r"\$\s*[0-9]") & pct(name).isNull(), None).otherwise(pct(text))


def clock_window(text: Column) -> Column:
    """struct(start_time, end_time) of "7-8am" and the like; the start takes the end's half of the day if it states none."""
    pattern = r"(?i)([0-9]{1,2})(?::([0-9]{2}))?\s*(am|pm)?\s*[-–—]\s*([0-9]{1,2})(?::([0-9]{2}))?\s*(am|pm)"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    half = F.lower(part(6))

    def at(hour: Column, minute: Column, ap: Column) -> Column:
        h = hour.try_cast("int") % 12 + F.when(ap == "pm", 12).otherwise(0)
        return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.coalesce(minute, F.lit("00")))

    made = F.struct(at(part(1), part(2), F.coalesce(F.lower(part(3)), half)).alias("start_time"), at(part(4), part(5), half).alias("end_time"))
    return F.when(half.isNotNull(), made)


def plain_html(html: Column) -> Column:
    """Tags to spaces, the common entities decoded, spaces collapsed."""
    s = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[\s ]+", " "))


def card_deals(pages: DataFrame, card: str) -> DataFrame:
    """pages: page_id, html. Deals of the cards that match the pattern `card` and state a percentage off."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(card), F.lit(0))).alias("pos", "card"))
    told = each.select("page_id", "pos", plain_html(F.col("card")).alias("text")).where(F.col("text").rlike(r"[0-9]+\s*%") & F.col("text").rlike("(?i)off"))
    w = clock_window(F.col("text"))
    return told.select(
        "page_id",
        "pos",
        F.when(w.isNotNull(), "happy_hour").otherwise("daily").alias("type"),
        F.col("text").alias("description"),
        F.regexp_extract("text", r"([0-9]+)\s*%", 1).try_cast("int").alias("discount_pct"),
        w["start_time"].alias("start_time"),
        w["end_time"].alias("end_time"),
        weekdays_within(F.col("text")).alias("days_valid"),
    )


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the primary source; of the fallback for keys the primary has none of."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def first_nonempty(attempts: DataFrame, key: str, attempt: str, size: str) -> DataFrame:
    """The first attempt of each key that brought anything."""
    first = Window.partitionBy(key).orderBy(attempt)
    return attempts.where(F.col(size) > 0).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def in_bounds(lat: Column, lng: Column) -> Column:
    return lat.between(BOUNDS[0], BOUNDS[1]) & lng.between(BOUNDS[2], BOUNDS[3])


def filled_places(places: DataFrame, found: DataFrame) -> DataFrame:
    """Coordinates found within bounds, only for places that have none."""
    usable = found.where(in_bounds(F.col("lat"), F.col("lng"))).select("dispensary_id", F.struct("lat", "lng").alias("_found"))
    own = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    place = F.coalesce(own, F.col("_found"))
    joined = places.withColumn("_own", own).join(usable, "dispensary_id", "left")
    return joined.withColumn("_p", F.coalesce("_own", "_found")).withColumn("lat", F.col("_p.lat")).withColumn("lng", F.col("_p.lng")).drop("_own", "_found", "_p")


def zip_key(zip_code: Column) -> Column:
    trimmed = F.trim(zip_code)
    return F.when(trimmed.rlike(r"^[0-9]{5}(-[0-9]{4})?$"), F.left(trimmed, F.lit(5)))


def log_rows(lines: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """lines: value. Parsed rows, and one row counting lines, malformed ones and ones without a required key. Blank lines count for nothing."""
    parsed = lines.where("trim(value) <> ''").select(F.from_json("value", f"struct<{schema},_bad:string>", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"r.{name}").isNull()
    bad = F.col("r._bad").isNotNull()
    counts = parsed.agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"), F.count_if(~bad & missing).alias("incomplete"))
    return parsed.where(~bad & ~missing).select("r.*").drop("_bad"), counts


def feed_posts(bodies: DataFrame) -> DataFrame:
    """bodies: body, a JSON listing. Posts with an id; other fields default to ''."""
    shape = "struct<data:struct<children:array<struct<data:struct<id:string,title:string,selftext:string,permalink:string,created_utc:double>>>>>"
    each = bodies.select(F.explode(F.from_json("body", shape)["data"]["children"]).alias("c")).select("c.data.*").where("id is not null and id <> ''")
    return each.fillna("", ["title", "selftext", "permalink"])


def feed_entries(bodies: DataFrame) -> DataFrame:
    """bodies: body, an XML feed. Entries whose id is a post's, texts decoded twice."""
    each = bodies.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("e"))
    tag = lambda name: F.regexp_extract("e", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)
    post = F.regexp_extract(tag("id"), r"t3_([A-Za-z0-9]+)", 1)
    return each.select(post.alias("id"), plain_html(plain_html(tag("title"))).alias("title"), plain_html(plain_html(tag("content"))).alias("text")).where("id <> ''")


def first_domains(lines: DataFrame) -> DataFrame:
    """lines: value, CSV, TSV or semicolons without a header. The first cell of each row that is a domain or URL."""
    cells = F.transform(F.split("value", "[,\t;]"), lambda c: F.lower(F.regexp_replace(F.trim(c), r"^[\"']|[\"']$", "")))
    host = lambda c: F.when(c.rlike("^https?://"), F.regexp_extract(c, "^https?://([^/?#:]+)", 1)).when(c.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), c)
    found = F.filter(F.transform(cells, host), lambda h: F.coalesce(h != "", F.lit(False)))
    return lines.select(F.regexp_replace(F.get(found, F.lit(0)), r"^www\.", "").alias("domain")).where("domain is not null").distinct()


def loose_json(text: Column) -> Column:
    """The JSON that a text is or holds: whole, in a fence, the widest brackets, the widest braces; as a variant or null."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(
        F.try_parse_json(text),
        F.try_parse_json(F.nullif(fence, F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))),
    )


def read_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or an empty table of its schema where the path does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
