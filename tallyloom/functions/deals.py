"""Deals: windows, activity, scope, categories and titles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let

# Weekdays in order, cue patterns of scopes.
DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
EVERYDAY = "everyday"
UNSUPPORTED = [
    r"\bedibles?\b",
    r"\bgummies?\b",
    r"\bgummy\b",
    r"\bchocolates?\b",
    r"\bdrinks?\b",
    r"\bbeverages?\b",
    r"\bsodas?\b",
    r"\btopicals?\b",
    r"\btinctures?\b",
    r"\bcapsules?\b",
    r"\btablets?\b",
]
STOREWIDE = [
    r"store[-\s]?wide",
    r"entire (menu|store|order)",
    r"whole (store|menu)",
    r"\beverything\b",
    r"all (products|items|online orders|orders)",
]


def minutes_of(time: Column) -> Column:
    """Minutes of a strict HH:MM, else null."""
    ok = time.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")
    return F.when(ok, F.substring(time, 1, 2).try_cast("int") * 60 + F.substring(time, 4, 2).try_cast("int"))


def usable_window(start: Column, end: Column) -> Column:
    ok = lambda t: t.isNull() | minutes_of(t).isNotNull()
    return ok(start) & ok(end) & F.coalesce(start != end, F.lit(True))


def usable_days(days: Column) -> Column:
    known = F.array(*[F.lit(d) for d in [*DAYS, EVERYDAY]])
    return F.coalesce((F.size(days) > 0) & F.forall(days, lambda d: F.array_contains(known, d)), F.lit(False))


def deal_active(days: Column, start: Column, end: Column, day: str, minute: int, check_days: bool = True) -> Column:
    """Whether a deal holds on weekday `day` at minute `minute`.

    Without both ends the day decides; a window within a day is [start, end); one over midnight runs
    from its day into the next. check_days=False judges the window alone and takes a malformed one as open.
    """
    yesterday = DAYS[(DAYS.index(day) - 1) % 7]
    on = lambda d: F.array_contains(days, EVERYDAY) | F.array_contains(days, d) if check_days else F.lit(True)
    s, e, now = minutes_of(start), minutes_of(end), F.lit(minute)
    within = on(day) & (now >= s) & (now < e)
    overnight = (on(day) & (now >= s)) | (on(yesterday) & (now < e))
    return F.when(s.isNull() | e.isNull(), on(day)).when(e > s, within).otherwise(overnight)


def minutes_until(end: Column, minute: int) -> Column:
    return F.pmod(minutes_of(end) - F.lit(minute), F.lit(24 * 60))


#: What a deal's text says it covers, first fit wins. pattern, pattern that must not fit, kind, category, grams.
SCOPES = [
    (r"pre[-\s]?roll", None, "category", "Pre-Rolls", None),
    (r"vape|vapor|cartridge|\bpen", None, "category", "Vaporizers", None),
    (r"\bcart\b", r"\b(?:in\s+)?your\s+cart\b", "category", "Vaporizers", None),
    (r"\beighths?\b|1\s*/\s*8", None, "category", "Flower", 3.5),
    (r"\bounces?\b|\boz\b", None, "category", "Flower", 28.0),
    (r"\bflower\b", None, "category", "Flower", None),
    ("|".join(STOREWIDE), None, "storewide", None, None),
    (r"\bbrands?\b(?!\s+new)", None, "brand", None, None),
]


def deal_scope(description: Column) -> Column:
    """struct(kind, category, weight_grams, targeted): what a deal's text says it covers.

    targeted is the word that names goods out of the catalog. Ambiguity is 'unresolved', never storewide.
    """
    def made(kind: str, category: str | None = None, grams: float | None = None, targeted: Column | None = None) -> Column:
        word = F.lit(None).cast("string") if targeted is None else targeted
        return F.struct(F.lit(kind).alias("kind"), F.lit(category).cast("string").alias("category"), F.lit(grams).cast("double").alias("weight_grams"), word.alias("targeted"))

    def scope(d: Column) -> Column:
        found = made("unresolved")
        for pattern, unless, kind, category, grams in reversed(SCOPES):
            fits = d.rlike(pattern) if unless is None else d.rlike(pattern) & ~d.rlike(unless)
            found = F.when(fits, made(kind, category, grams)).otherwise(found)
        words = [F.nullif(F.regexp_extract(d, f"({cue})", 1), F.lit("")) for cue in UNSUPPORTED]
        return let(F.coalesce(*words), lambda word: F.when(word.isNotNull(), made("unsupported-category", targeted=word)).otherwise(found))

    return let(F.lower(description), scope)


def layered_sale(description: Column) -> Column:
    """struct(pct, subject) of "Up to X% off sale - Y% off subject" with Y over zero; null otherwise."""
    pattern = r"(?i)^\s*up to\s+[0-9]+(?:\.[0-9]+)?\s*%\s*off\s+sale\s*[-–—]\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*off\s+(.+?)\s*$"
    pct = F.regexp_extract(description, pattern, 1).try_cast("double")
    return F.when(pct > 0, F.struct(pct.alias("pct"), F.regexp_extract(description, pattern, 2).alias("subject")))


SEPARATORS = r"[\s·:•–—*-]*"


def without_discount(title: Column, pct: Column) -> Column:
    """The title without the figure its badge shows; unchanged where it states two figures or none would be left."""
    number = F.when(pct == F.floor(pct), F.floor(pct).cast("string")).otherwise(pct.cast("string"))
    figure = F.concat(F.lit(r"(?i)\b"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(rf"\s*%\s*(?:off\b)?{SEPARATORS}"))
    left = F.trim(F.regexp_replace(F.regexp_replace(title, figure, F.lit("")), rf"^{SEPARATORS}|{SEPARATORS}$", ""))
    return F.when((F.regexp_count(title, F.lit(r"[0-9]+(?:\.[0-9]+)?\s*%")) >= 2) | pct.isNull(), title).otherwise(left)


def without_location(title: Column, tags: tuple[str, ...] = ("PULLMAN",)) -> Column:
    """The title without a closing tag of another location."""
    pattern = rf"(?i){SEPARATORS}\b(?:{'|'.join(tags)})\b\s*$"
    return F.trim(F.regexp_replace(F.regexp_replace(title, pattern, ""), rf"^{SEPARATORS}|{SEPARATORS}$", ""))


# Icons and the words they stand for, in their order.
FALSE_FRIENDS = r"(?i)join the joint|\bcookies\b|\bglass house\b"
EXCLUSIONS = r"(?i)\((?:excl|exclud)[^)]*\)|\b(?:excluding|excludes|excl\.?|not valid on)\b[^,.;)]*"
PRODUCTS = [
    ("bud", r"\bflowers?\b|\bbuds?\b|\bounces?\b|\boz\b|\b[0-9]+\s?g\b|\beighths?\b|\bsmalls\b|\bpopcorn\b"),
    ("vape", r"\bvapes?\b|\bcarts?\b|\bcartridges?\b|\bdispos?\b|\bdisposables?\b"),
    ("edible", r"\bedibles?\b|\bgummies\b|\bgummy\b|\bchocolates?\b|\blollipops?\b|\bbrownies?\b|\bchews?\b"),
    ("drink", r"\bdrinks?\b|\bbeverages?\b|\bsodas?\b|\bseltzers?\b|\blemonade\b"),
    ("tincture", r"\btinctures?\b|\btopicals?\b|\bcapsules?\b|\bsalves?\b|\bbalms?\b"),
    ("glass", r"\bglass(?:ware)?\b|\bbongs?\b|\bdab rigs?\b|\bwater pipes?\b|\bhand pipes?\b"),
]
PRE_ROLL_WORDS = r"\bpre.?rolls?\b|\bjoints?\b|\bfirecrackers?\b|\bsparklers?\b"
PACKS = [("joint-triple", r"\btriple\b|\b3\s?-?\s?(?:pk|pack)\b"), ("joint-double", r"\bdouble\b|\b2\s?-?\s?(?:pk|pack)\b")]
CONCENTRATES = [
    ("shatter", r"\bshatter(?:day)?s?\b"),
    ("diamond", r"\bdiamonds?\b|\blive resin\b|\bresin\b"),
    ("dabs", r"\bdabs?\b(?!\s?rigs?\b)|\bwax\b|\bbudder\b|\bbadder\b|\bsauce\b|\bsugar\b|\brosin\b"),
    ("concentrate", r"\bconcentrates?\b|\bextracts?\b|\brso\b"),
]
WHOLE_STORE = r"\bstore\s?wide\b|\bentire (?:order|purchase|store)\b|\ball (?:cannabis|products|items)\b|\beverything\b|\bwhole store\b|\bsite\s?wide\b"
WHOLE_ORDER = r"\bonline orders?\b|\byour purchase\b|\bitems purchased\b|\bsingle purchases?\b|\bcustomer groups?\b"
PRICE = r"\$\s?[0-9]"
PRICE_FLOOR = r"\b(?:than|over|above|greater|spend|min(?:imum)?|orders?\s+(?:over|above|of))\b[^$]{0,15}\$\s?[0-9]"


def deal_icons(description: Column) -> Column:
    """Icons of a deal, families by where they first stand; whole-store and whole-order deals have their own alone."""
    return let(description, lambda d: let(F.regexp_replace(F.regexp_replace(d, EXCLUSIONS, " "), FALSE_FRIENDS, " "), lambda text: _icons(d, text)))


def _icons(description: Column, text: Column) -> Column:
    """text: the description without what it excludes and without words that only look like goods."""
    has = lambda p: text.rlike(f"(?i){p}")
    at = lambda p: F.regexp_instr(text, F.lit(f"(?i){p}"))
    hit = lambda name, p: F.struct(at(p).alias("at"), F.lit(0).alias("rank"), name.alias("name"))
    pack = F.when(has(PACKS[0][1]), PACKS[0][0]).when(has(PACKS[1][1]), PACKS[1][0]).otherwise("joint-single")
    hits = [hit(F.lit(n), p) for n, p in PRODUCTS] + [hit(pack, PRE_ROLL_WORDS)]
    one = F.lit(None).cast("struct<at:int,rank:int,name:string>")
    for n, p in reversed(CONCENTRATES):
        one = F.when(has(p), hit(F.lit(n), p)).otherwise(one)
    ranked = F.transform(F.array(*hits, one), lambda h, k: F.struct(h["at"].alias("at"), k.alias("rank"), h["name"].alias("name")))
    found = F.array_sort(F.filter(ranked, lambda h: F.coalesce(h["at"] > 0, F.lit(False))))
    priced = has(PRICE) & ~has(PRICE_FLOOR)

    def told(icons: Column) -> Column:
        all_of = F.when(priced, F.concat(icons, F.array(F.lit("price-drop")))).otherwise(icons)
        return let(all_of, lambda i: F.when(F.size(i) == 0, F.array(F.lit("special-pricing"))).otherwise(i))

    return (
        F.when(F.trim(F.coalesce(description, F.lit(""))) == "", F.array().cast("array<string>"))
        .when(has(WHOLE_STORE), F.array(F.lit("store-wide")))
        .when(has(WHOLE_ORDER), F.array(F.lit("online-order")))
        .otherwise(let(F.array_distinct(F.transform(found, lambda h: h["name"])), told))
    )


def deal_categories(description: Column) -> Column:
    """Icons of the subject of a layered sale, else of the whole text, packs of pre-rolls taken together."""
    icons = deal_icons(F.coalesce(layered_sale(description)["subject"], description))
    return F.array_distinct(F.transform(icons, lambda n: F.when(n.startswith("joint-"), "joint-single").otherwise(n)))


def tier_key(kind: Column, start: Column, end: Column, pct: Column, minute: int) -> tuple[Column, Column]:
    """Order of the deal feed: timed happy hours by minutes left, all-day ones, then the rest by discount."""
    timed = minutes_of(start).isNotNull() & minutes_of(end).isNotNull()
    happy = kind == "happy_hour"
    tier = F.when(happy & timed, 0).when(happy, 1).otherwise(2)
    value = F.when(happy & timed, minutes_until(end, minute)).when(happy, F.lit(0)).otherwise(-F.coalesce(pct, F.lit(0)))
    return tier, value
