"""Text, URL and label functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let

# Terms that a description may not hold, and its length.
BLOCKED_TERMS = [
    "cure",
    "cures",
    "heals",
    "healing",
    "relieves pain",
    "pain relief",
    "treats anxiety",
    "medical benefit",
    "therapeutic",
    "medicinal",
    "kid",
    "kids",
    "cartoon",
]
DESCRIPTION_LENGTH = 160
#: White space and control characters but the plain space.
CONTROLS = r"\x00-\x1F\x7F   -     　"
PICTOGRAPHS = (
    r"[©®‼⁉™ℹ↔-↪⌚-⏿Ⓜ▪-◾☀-➿⤴⤵"
    r"⬅-⭕〰〽㊗㊙\x{1F000}-\x{1FAFF}­͏؜ᅟᅠ឴឵᠋-᠏"
    r"​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\x{E0000}-\x{E0FFF}]"
)


def blocked(text: Column) -> Column:
    """True where a blocked term stands as whole words, by ASCII word edges."""
    first = "".join(sorted({t[0] for t in BLOCKED_TERMS}))  # looked at before all else, as few characters begin a term
    return text.rlike(rf"(?i)(?=[{first}])(?<![A-Za-z0-9_])(?:" + "|".join(BLOCKED_TERMS) + r")(?![A-Za-z0-9_])")


def clean_description(raw: Column) -> Column:
    """Tags, pictographs and control characters to spaces, spaces collapsed; '' if blocked; cut at a word at 160."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]*>", " ")
    s = F.regexp_replace(s, r"(?![\x00-\xA8])" + PICTOGRAPHS, " ")  # none stands before U+00A9
    # runs of two or more, and single ones that are no plain space: the others stay as they are
    s = F.trim(F.regexp_replace(s, rf"[\x20{CONTROLS}]{{2,}}|[{CONTROLS}]", " "))
    return let(s, lambda t: F.when(blocked(t), "").otherwise(_cut(t)))


def _cut(s: Column) -> Column:
    """s, or what stands before the last space of its first 160 characters where it is longer."""
    at_word = lambda head: F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    short = lambda head: let(at_word(head), lambda w: F.rtrim(F.when(w != "", w).otherwise(head)))
    return F.when(F.length(s) <= DESCRIPTION_LENGTH, s).otherwise(let(F.left(s, F.lit(DESCRIPTION_LENGTH)), short))


def slug(s: Column) -> Column:
    """Lower case, runs of other characters to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(s: Column) -> Column:
    return F.initcap(F.regexp_replace(s, "-", " "))


def percent_in(text: Column) -> Column:
    """First "N%" of a text as an integer."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+)\s*%", 1), F.lit("")).try_cast("int")


def url_host(url: Column) -> Column:
    """Host in lower case without a leading www.; null where the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def host_matches(host: Column, domain: Column) -> Column:
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def mention_key(url: Column) -> Column:
    """Host and lower-case path, without scheme, query, fragment and closing slash."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(url_host(url), F.regexp_replace(path, "/+$", ""))


def collapsed(s: Column) -> Column:
    """For brand matching: lower case, apostrophes out, everything else that is no letter or digit out too."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "['’]", ""), "[^a-z0-9]+", "")


def phrase_present(text: Column, phrase: Column) -> Column:
    """Whole-phrase containment between single spaces."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def city_of(address: Column) -> Column:
    """City of "STREET, CITY, ST ZIP"."""
    return F.nullif(F.trim(F.regexp_extract(address, r"^.*,\s*([^,]+),\s*[A-Z]{2}\s+[0-9]{5}(?:-[0-9]{4})?\s*$", 1)), F.lit(""))


def escape_html(s: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def join_names(names: Column) -> Column:
    """"A", "A and B", "A, B and C"."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, names[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def plain_phrase(s: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))
