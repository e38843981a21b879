"""SQL that gives the rows of the queries over runs, written for DuckDB and apart from them."""

from __future__ import annotations

from .oracles import ARRIVALS, EVENTS, FACTS, GATED, HEALTH, MEDIANS, PAIRS, PLACE, RECORDS, TOPIC
from .oracles import ORACLES as FIRST

DAY = "2024-01-30"
_HEALTH = f"WITH {EVENTS}, {HEALTH.format(day=DAY, extra='')}"
_ARRIVALS = "WITH " + ARRIVALS.replace("2024-01-10", DAY)
_MG = "CAST(weight_grams * 1000 AS BIGINT)"
_SOUND = "category <> 'Edible' AND NOT flagged AND quantity > 0 AND coalesce(special_price, base_price) > 0"
_BRANDED = f"""WITH {RECORDS},
    b AS (SELECT brand_key, arg_min(trim(brand), (-n, brand)) AS display_brand FROM (SELECT brand_key, brand, count(*) AS n FROM rec WHERE brand IS NOT NULL GROUP BY ALL) GROUP BY 1),
    m AS (SELECT brand_key, count(*) AS product_count, count(DISTINCT dispensary_id) AS stores, count(DISTINCT weight_grams) FILTER ({_SOUND}) AS tiers
      FROM rec WHERE brand IS NOT NULL GROUP BY 1)"""
_CELLS = f"""WITH {RECORDS},
    s AS (SELECT brand_key, match_key, weight_grams, dispensary_id, min(coalesce(special_price, base_price)) AS price FROM rec WHERE brand IS NOT NULL AND {_SOUND} GROUP BY ALL),
    c AS (SELECT brand_key, match_key, weight_grams, min(price) AS low_price FROM s GROUP BY ALL HAVING count(*) >= 2)"""

#: fact: (item, amount, relation)
_FACTS = {
    "disparities": (f"match_key || ' / ' || {_MG}", "round(spread * 100)", FIRST["d1_disparities"]),
    "deal_scope": ("deal_id || ' / ' || kind", "linked", FIRST["d2_deal_links"]),
    "extraction_health": ("dispensary_id || ' / ' || status", "observed_days", _HEALTH + " SELECT * FROM status"),
    "special_events": ("dispensary_id || ' / ' || product_id || ' / ' || state", "1", FIRST["d4_special_states"] + " WHERE now IS NOT NULL AND before IS NOT NULL AND now <> before"),
    "rollup_category": ("category || ' / ' || distinct_stores", "disparity_count", FIRST["d5_rollup_category"]),
    "rollup_store": ("dispensary_id || ' / ' || times_priciest", "times_cheapest", FIRST["d5_rollup_store"]),
    "brand_personas": ("brand_key || ' / ' || display_brand || ' / ' || persona", "special_product_days", FIRST["d6_brand_personas"]),
    "brand_matrix": ("brand_key || ' / ' || display_brand", "product_count * 1000 + stores + tiers", _BRANDED + " SELECT * FROM m JOIN b USING (brand_key)"),
    "brand_cells": (f"brand_key || ' / ' || match_key || ' / ' || {_MG}", "round(low_price * 100)", _CELLS + " SELECT * FROM c"),
    "arrivals": ("dispensary_id || ' / ' || product_id || ' / ' || outcome", "absent_runs", _ARRIVALS + " SELECT * FROM outcome WHERE outcome IN ('arrival', 'dormant')"),
    "own_median": ("dispensary_id || ' / ' || product_id || ' / ' || outcome", "observed_days", f"WITH {MEDIANS} SELECT * FROM moved WHERE outcome IN ('below-median', 'above-median')"),
    "delivered": (f"dispensary_id || ' / ' || match_key || ' / ' || {_MG}", "round(price * 100)", FIRST["d10_delivered_offers"]),
    "region_members": ("cluster_id || ' / ' || dispensary_id", "1", f"WITH RECURSIVE {PAIRS} SELECT * FROM member"),
    "region_floors": (f"cluster_id || ' / ' || match_key || ' / ' || {_MG}", "store_count_in_cluster", FIRST["d11_floors"]),
    "region_gaps": (
        "cluster_id || ' / ' || category",
        "1",
        f"""WITH RECURSIVE {RECORDS}, {PAIRS} SELECT DISTINCT cluster_id, category FROM member, (SELECT DISTINCT category FROM rec)
            EXCEPT SELECT cluster_id, category FROM rec JOIN member USING (dispensary_id)""",
    ),
}

#: fact: (relation, {counter: aggregate})
_COUNTS = {
    "disparities": (
        f"WITH {GATED} SELECT reason FROM gate",
        {"total_records": "count(*)", "non_comparable_category": "count(*) FILTER (reason = 'category')", "excluded_flag": "count(*) FILTER (reason = 'flag')", "unmatched": "0",
         "stale": "count(*) FILTER (reason = 'stale')", "disparities": f"(SELECT count(*) FROM ({FIRST['d1_disparities']}))"},
    ),
    "deal_scope": (
        FIRST["d2_deal_links"],
        {"total_deals": "count(*)", **{k.replace("-", "_"): f"count(*) FILTER (kind = '{k}')" for k in ("storewide", "category", "brand", "unsupported-category", "unresolved")},
         "zero_match": "count(*) FILTER (kind IN ('storewide', 'category') AND linked = 0)", "linked_products": "sum(linked)"},
    ),
    "extraction_health": (
        _HEALTH + " SELECT * FROM status",
        {"total_stores": "count(*)", **{k.replace("-", "_"): f"count(*) FILTER (status = '{k}')" for k in ("ok", "suspected-extraction-failure", "insufficient-history")}},
    ),
    "special_events": (
        FIRST["d4_special_states"],
        {"total_products": "count(*)", **{k.replace("-", "_"): f"count(*) FILTER (state = '{k}')" for k in ("special-start", "special-end", "unchanged", "gap", "first")}},
    ),
    "rollup_category": (FIRST["d5_rollup_category"], {"categories": "count(*)"}),
    "rollup_store": (FIRST["d5_rollup_store"], {"stores": "count(*)", "missing_place": "count(*) FILTER (lat IS NULL)"}),
    "brand_personas": (
        FIRST["d6_brand_personas"],
        {"null_brand_products": "0", "total_brands": "count(*)",
         **{k.replace("-", "_"): f"count(*) FILTER (persona = '{k}')" for k in ("always-on-special", "never-discounted", "intermittently-discounted", "insufficient-history")}},
    ),
    "brand_matrix": (
        f"WITH {RECORDS} SELECT * FROM rec",
        {"null_brand_products": "count(*) FILTER (brand IS NULL)", "unmatched_products": "count(*) FILTER (brand IS NOT NULL AND match_key IS NULL)",
         "total_brands": "count(DISTINCT brand_key)", "multi_store_brands": f"(SELECT count(*) FROM ({_BRANDED} SELECT * FROM m) WHERE stores >= 2)"},
    ),
    "brand_cells": (_CELLS + " SELECT * FROM c", {"cheapest_cells": "count(*)"}),
    "arrivals": (
        _ARRIVALS + " SELECT * FROM outcome",
        {"total_products": "count(*)", **{k.replace("-", "_"): f"count(*) FILTER (outcome = '{k}')" for k in ("arrival", "onboarding", "present", "suppressed", "dormant", "below-threshold")}},
    ),
    "own_median": (
        f"WITH {MEDIANS} SELECT * FROM moved",
        {"no_usable_price": f"(WITH {EVENTS} SELECT count(*) FROM ev WHERE (price IS NULL OR price <= 0) AND day BETWEEN DATE '2024-01-01' AND DATE '{DAY}')", "total_series": "count(*)",
         **{k.replace("-", "_"): f"count(*) FILTER (outcome = '{k}')" for k in ("below-median", "above-median", "at-median", "below-floor", "no-observation-today")}},
    ),
    "delivered": (
        FIRST["d10_delivered_offers"],
        {"total_cells": "count(DISTINCT (match_key, weight_grams))", "store_offers": "count(*)", "offers_with_place": "count(lat)", "missing_place": "count(*) FILTER (lat IS NULL)"},
    ),
    "region_members": (f"WITH RECURSIVE {PAIRS} SELECT * FROM member", {"clustered_stores": "count(*)", "unclustered_stores": "0", "members": "count(*)"}),
    "region_floors": (FIRST["d11_floors"], {"total_floors": "count(*)", "single_store_floors": "count(*) FILTER (store_count_in_cluster = 1)"}),
    "region_gaps": (f"WITH RECURSIVE {PAIRS} SELECT * FROM member", {"total_clusters": "count(DISTINCT cluster_id)", "suppressed_clusters": "0"}),
}

_ROWS = [f"SELECT '{fact}' AS fact, {item} AS item, CAST({amount} AS BIGINT) AS amount FROM ({relation})" for fact, (item, amount, relation) in _FACTS.items()]
_ROWS += [
    f"SELECT '{fact}' AS fact, unnest([{', '.join(repr('counter ' + c) for c in counts)}]) AS item, unnest([{', '.join(f'CAST(coalesce({a}, 0) AS BIGINT)' for a in counts.values())}]) AS amount FROM ({relation})"
    for fact, (relation, counts) in _COUNTS.items()
]

_AFTER = "lead(ts) OVER (PARTITION BY store ORDER BY ts)"

ORACLES = {
    "derive_run": "\nUNION ALL ".join(f"SELECT * FROM ({r})" for r in _ROWS),
    "st3_stream_staleness": f"""WITH p AS (SELECT DISTINCT 'v' || user_id % 40 AS store, ts FROM events),
        g AS (SELECT store, ts, ts - lag(ts) OVER (PARTITION BY store ORDER BY ts) AS since, {_AFTER} - ts AS until FROM p),
        t AS (SELECT store, ts AS happened, 'ok' AS state FROM g WHERE since IS NULL OR since > INTERVAL 3 HOUR
          UNION ALL SELECT store, ts + INTERVAL 3 HOUR, 'stale' FROM g WHERE until IS NULL OR until > INTERVAL 3 HOUR
          UNION ALL SELECT store, ts + INTERVAL 6 HOUR, 'alert' FROM g WHERE until IS NULL OR until > INTERVAL 6 HOUR
          UNION ALL SELECT store, ts + INTERVAL 24 HOUR, 'expired' FROM g WHERE until IS NULL OR until > INTERVAL 24 HOUR)
        SELECT store AS dispensary_id, CAST(happened AS VARCHAR) AS "at", state FROM t""",
    "st4_stream_told": """WITH RECURSIVE e AS (SELECT user_id, ts, event_id FROM events),
        r(user_id, ts, event) AS (
          SELECT user_id, min(ts), arg_min(event_id, (ts, event_id)) FROM e GROUP BY user_id
          UNION ALL
          SELECT user_id, ts, event_id FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS n
            FROM r JOIN e ON e.user_id = r.user_id AND e.ts > r.ts + INTERVAL 5 DAY) WHERE n = 1)
        SELECT user_id, CAST(ts AS VARCHAR) AS "at", event FROM r""",
    "f26_phrase_index": r"""WITH t AS (SELECT conv_id || '-' || turn AS id, trim(regexp_replace(lower(coalesce(any_value(text), '')), '[^a-z0-9]+', ' ', 'g')) AS s FROM conversations GROUP BY 1),
        p AS (SELECT DISTINCT array_to_string(string_split(s, ' ')[1:3], ' ') AS phrase FROM t),
        w AS (SELECT DISTINCT array_to_string(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ')[1:2], ' ') AS phrase FROM documents),
        g AS (SELECT id, arg_min(phrase, (-length(phrase), phrase)) AS geo FROM t JOIN p ON phrase <> '' AND contains(' ' || s || ' ', ' ' || phrase || ' ') GROUP BY id),
        h AS (SELECT id, min(phrase) AS term FROM t JOIN w ON phrase <> '' AND contains(' ' || s || ' ', ' ' || phrase || ' ') GROUP BY id)
        SELECT id, geo, term, CASE WHEN geo IS NULL THEN 'no place' WHEN term IS NULL THEN 'no product' END AS reason FROM t LEFT JOIN g USING (id) LEFT JOIN h USING (id)""",
    "x12_mention_candidates": f"""WITH RECURSIVE {FACTS},
        post AS (SELECT page_id AS post_id, page_id % 8 AS intent, CASE page_id // 8 % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt' END AS brand,
          {TOPIC.format(n="page_id")} AS topic, {PLACE.format(n="(page_id // 2)")} AS place FROM pages WHERE page_id % 8 <> 0),
        ask AS (SELECT DISTINCT topic, place FROM post),
        one AS (SELECT topic, place, kind, category, price, k3 AS name FROM (
          SELECT a.topic, a.place, f.*, row_number() OVER (PARTITION BY a.topic, a.place ORDER BY o, k1, k2, k3, k4, k5, f.category) AS n
          FROM ask a JOIN meant m ON m.place = a.place JOIN fit USING (topic) JOIN fact f ON f.category = fit.category AND (f.o = 2 OR f.region = m.region OR (f.o = 3 AND m.region IS NULL))
          WHERE m.place_kind <> 'outside' AND NOT (m.place_kind = 'uncovered' AND a.place <> '')) WHERE n = 1),
        kept AS (SELECT p.post_id, o.* FROM post p LEFT JOIN one o ON o.topic = p.topic AND o.place = p.place
          AND NOT (p.intent IN (2, 6) AND p.brand IS NOT NULL AND NOT contains(' ' || lower(o.name) || ' ', ' ' || p.brand || ' ')))
        SELECT post_id, kind AS fact, category, price, CASE kind WHEN 'regional-floor' THEN '2024-01-30 04:00:00' WHEN 'disparity' THEN '2023-11-01 04:00:00' END AS fact_as_of,
          CASE WHEN kind IS NULL THEN '' WHEN kind = 'regional-floor' THEN 'fresh' WHEN kind = 'disparity' THEN 'stale' ELSE '' END AS freshness FROM kept""",
    "s31_area_codes": """SELECT 's' || s_suppkey AS dispensary_id, CASE s_suppkey % 5 WHEN 0 THEN '360,564' WHEN 1 THEN '425,564' WHEN 2 THEN '360,564' ELSE '' END AS codes,
        CASE s_suppkey % 5 WHEN 0 THEN '360,the 360,564,the 564' WHEN 1 THEN '425,the 425,564,the 564' WHEN 2 THEN '360,the 360,564,the 564' ELSE '' END AS keywords,
        CASE s_suppkey % 5 WHEN 0 THEN 'Locals sometimes call the Bellingham area "the 360."' WHEN 1 THEN 'Locals sometimes call the Everett area "the 425."'
          WHEN 2 THEN 'Locals sometimes call the Mount Vernon area "the 360."' ELSE '' END AS nickname FROM supplier""",
    "snk5_upsert": f"""WITH {EVENTS}, d AS (SELECT dispensary_id, product_id, day, count(*) AS n, arg_max(brand, seq) AS brand FROM ev GROUP BY ALL)
        SELECT dispensary_id, product_id, arg_max(brand, day) AS brand, CAST(max(day) AS VARCHAR) AS last_day,
          string_agg(strftime(day, '%m%d') || ':' || n, ',' ORDER BY day) AS history FROM d GROUP BY ALL""",
    "st7_daily_medians": f"WITH {MEDIANS} SELECT dispensary_id, product_id, outcome, current_price, median_price, pct_vs_median, observed_days FROM moved",
    "o7_ranked_gaps": f"WITH {GATED} SELECT match_key, weight_grams, spread, row_number() OVER (ORDER BY spread DESC, match_key, weight_grams) AS place FROM gap",
}
