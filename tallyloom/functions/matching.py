"""Topics, places, hosts, agents and probes: which rule a text falls under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug, url_host

# Words and names that results depend on.
TOPIC_WORDS = {
    "vaporizers": "vape vapes vaporizer cart carts cartridge cartridges disposable".split(),
    "flower": "flower bud buds eighth eighths ounce oz".split(),
    "concentrate": "concentrate concentrates dab dabs rosin resin wax hash shatter".split(),
    "edible": "edible edibles gummy gummies chocolate".split(),
    "prerolls": "preroll prerolls pre-roll joint joints".split(),
}
OUTSIDE = "or oregon portland eugene salem id idaho boise coeur ca california ak alaska mt montana nv nevada az arizona".split()
LOCALITIES = "seattle tacoma spokane olympia everett bellevue kent renton marysville bellingham yakima redmond kirkland auburn puyallup".split()
AREA_CODES = {"bellingham": ["360", "564"], "everett": ["425", "564"], "mount-vernon": ["360", "564"]}
AGENTS = [
    "Googlebot",
    "Google-Extended",
    "Bingbot",
    "GPTBot",
    "OAI-SearchBot",
    "ChatGPT-User",
    "ClaudeBot",
    "Claude-SearchBot",
    "Claude-User",
    "PerplexityBot",
    "Perplexity-User",
    "Applebot-Extended",
    "Applebot",
    "CCBot",
    "Meta-ExternalAgent",
    "Amazonbot",
    "Bytespider",
    "YandexBot",
    "Baiduspider",
    "DuckDuckBot",
    "Slurp",
    "crawler",
    "spider",
    "bot",
]


def topic_fits(topic: Column, category: Column) -> Column:
    """Whether a free topic means a category: no topic fits all; else a word equals one of the category's, its plural, or shares four letters or more from the start."""
    t, c = F.lower(F.trim(F.coalesce(topic, F.lit("")))), F.lower(F.trim(F.coalesce(category, F.lit(""))))
    table = F.create_map(*[x for k, v in TOPIC_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    keys = F.concat(F.array(c), F.coalesce(F.element_at(table, c), F.array().cast("array<string>")))
    words = F.filter(F.split(t, "[^a-z0-9]+"), lambda w: w != "")

    def fits(w: Column, k: Column) -> Column:
        plural = (w == F.concat(k, F.lit("s"))) | (k == F.concat(w, F.lit("s")))
        return (w == k) | plural | ((F.length(k) >= 4) & w.startswith(k)) | ((F.length(w) >= 4) & k.startswith(w))

    return F.when(t == "", True).when(c == "", False).when(c == t, True).otherwise(F.exists(words, lambda w: F.exists(keys, lambda k: fits(w, k))))


def place_kind(place: Column, region_slugs: Column) -> Column:
    """region, statewide, outside or uncovered, in this order. region_slugs: array of the slugs known."""
    p = F.lower(F.trim(F.coalesce(place, F.lit(""))))
    words = F.filter(F.split(p, "[^a-z0-9]+"), lambda w: w != "")
    any_of = lambda values: F.arrays_overlap(words, F.array(*[F.lit(v) for v in values]))
    return (
        F.when(p == "", "uncovered")
        .when(F.array_contains(region_slugs, slug(p)), "region")
        .when(p.isin("wa", "washington") | any_of(["statewide"]), "statewide")
        .when(any_of(OUTSIDE), "outside")
        .when(any_of(["wa", "washington"]) | any_of(LOCALITIES), "statewide")
        .otherwise("uncovered")
    )


def channel(url: Column) -> Column:
    """The channel to answer in, by host."""
    host = F.coalesce(url_host(url), F.lit(""))
    sub = F.regexp_extract(url, r"reddit\.com/(r/[A-Za-z0-9_]+)", 1)
    forum = (host == "reddit.com") | host.endswith(".reddit.com")
    press = host.contains("news") | host.endswith(".gov") | host.contains("times") | host.contains("herald")
    return (
        F.when(forum & (sub != ""), F.concat(F.lit("Reddit reply ("), sub, F.lit(")")))
        .when(forum, "Reddit reply")
        .when(press, "Local-news tip / comment")
        .when(host.endswith(".edu"), "Community/forum reply")
        .otherwise("IN-channel reply")
    )


def agent(user_agent: Column) -> Column:
    """The first known crawler token of a user agent, as the list spells it; null for none."""
    found = F.lower(F.regexp_extract(user_agent, "(?i)(" + "|".join(AGENTS) + ")", 1))
    table = F.create_map(*[F.lit(x) for a in reversed(AGENTS) for x in (a.lower(), a)])
    return F.when(found != "", F.element_at(table, found))


def probe_verdict(url: Column, status: Column) -> Column:
    """skip without a web link, ok for 2xx and 3xx, broken for 404 and 410, else unknown."""
    web = F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))
    return F.when(~web, "skip").when((status >= 200) & (status < 400), "ok").when(status.isin(404, 410), "broken").otherwise("unknown")


def uniform32(seed: Column) -> Column:
    """First draw of a small seeded 32-bit generator as a double in [0, 1); long arithmetic masked to 32 bits."""
    mask = F.lit(0xFFFFFFFF)

    def times(a: Column, b: Column) -> Column:
        low = a.bitwiseAND(F.lit(0xFFFF)) * b
        high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * 65536
        return (low + high).bitwiseAND(mask)

    a = (seed.cast("long") + 0x6D2B79F5).bitwiseAND(mask)
    t = times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = (t + times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296.0


def area_codes(region: Column) -> Column:
    """The telephone prefixes by which a region is called, its main one first; an empty list where none is known."""
    found = F.array().cast("array<string>")
    for name, codes in AREA_CODES.items():
        found = F.when(region == name, F.array(*[F.lit(c) for c in codes])).otherwise(found)
    return found


def area_code_keywords(region: Column) -> Column:
    """Each prefix, bare and with its article: words that a page may be found by, and no claim of service."""
    return F.flatten(F.transform(area_codes(region), lambda c: F.array(c, F.concat(F.lit("the "), c))))


def area_nickname(region: Column, label: Column) -> Column:
    """A sentence that names the main prefix; empty where none is known."""
    first = F.get(area_codes(region), F.lit(0))
    return F.coalesce(F.concat(F.lit("Locals sometimes call the "), label, F.lit(' area "the '), first, F.lit('."')), F.lit(""))
