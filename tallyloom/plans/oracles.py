"""SQL that gives the rows of the queries, written for DuckDB and apart from them."""

from __future__ import annotations

CATALOG = """
cat AS (
  SELECT p_partkey AS partkey, 'p' || p_partkey AS product_id, p_name AS name, p_size,
    CASE p_type WHEN 'ECONOMY' THEN 'Flower' WHEN 'SMALL' THEN 'Flower' WHEN 'STANDARD' THEN 'Vaporizers'
      WHEN 'PROMO' THEN 'Pre-Rolls' WHEN 'LARGE' THEN 'Concentrate' WHEN 'MEDIUM' THEN 'Edible' ELSE 'Other' END AS category,
    CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS brand, p_size::DOUBLE AS weight_grams,
    CASE WHEN p_type = 'LARGE' AND p_size % 3 = 0 THEN 'live resin' ELSE '' END AS form, p_partkey % 11 = 0 AS flagged
  FROM part),
keyed AS (
  SELECT *, coalesce(replace(lower(brand), '#', ' '), '') || '|' || array_to_string(list_sort(string_split(lower(name), ' ')), ' ')
      || '||' || replace(lower(category), '-', ' ') || CASE WHEN category = 'Concentrate' THEN '|' || form ELSE '' END AS match_key,
    replace(lower(brand), '#', ' ') AS brand_key
  FROM cat)"""

RECORDS = (
    CATALOG
    + """,
obs AS (
  SELECT *, CASE WHEN special THEN floor(base_price * (1 - l_discount) * 100 + 0.5::DOUBLE) / 100 END AS special_price
  FROM (SELECT l_partkey AS partkey, 's' || l_suppkey AS dispensary_id, l_orderkey * 8 + l_linenumber AS seq, l_shipdate AS observed_at,
      l_discount >= 0.05::DOUBLE AS special, l_discount, floor(l_extendedprice / l_quantity * 100 + 0.5::DOUBLE) / 100 AS base_price,
      CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS quantity FROM lineitem)),
rec AS (
  SELECT * EXCLUDE (partkey, n) FROM (SELECT o.*, row_number() OVER (PARTITION BY dispensary_id, partkey
      ORDER BY seq DESC, observed_at DESC, base_price DESC, quantity DESC, special DESC, special_price DESC) AS n FROM obs o) JOIN keyed USING (partkey)
  WHERE n = 1)"""
)

GATED = (
    RECORDS
    + """,
gate AS (
  SELECT *, CASE WHEN category = 'Edible' THEN 'category' WHEN flagged THEN 'flag'
    WHEN observed_at < (SELECT max(observed_at) FROM rec WHERE observed_at < DATE '2002-01-01') - INTERVAL 365 DAY THEN 'stale' END AS reason
  FROM rec),
offer AS (
  SELECT match_key, weight_grams, dispensary_id, product_id, name, category, coalesce(special_price, base_price) AS price
  FROM gate WHERE reason IS NULL AND quantity > 0 AND coalesce(special_price, base_price) > 0),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_key, weight_grams, dispensary_id ORDER BY price, product_id) AS n FROM offer) WHERE n = 1),
cell AS (
  SELECT match_key, weight_grams, min(price) AS low_price, max(price) AS high_price, count(*) AS stores,
    arg_min(name, (price, dispensary_id)) AS display_name, arg_min(category, (price, dispensary_id)) AS category,
    string_agg(dispensary_id, ',' ORDER BY price, dispensary_id) AS stores_carrying
  FROM best GROUP BY ALL HAVING count(*) >= 2),
gap AS (
  SELECT *, floor((high_price - low_price) * 100 + 0.5::DOUBLE) / 100 AS spread,
    floor((high_price - low_price) / low_price * 100 + 0.5::DOUBLE) / 100 AS spread_pct FROM cell),
flat AS (SELECT g.*, b.dispensary_id, b.price FROM gap g JOIN best b USING (match_key, weight_grams))"""
)

PLACES = """
place AS (
  SELECT 's' || s_suppkey AS dispensary_id, s_name, s_nationkey, s_acctbal AS balance,
    45.7::DOUBLE + (s_nationkey % 5) * 0.7::DOUBLE + (s_suppkey % 7) * 0.01::DOUBLE AS lat,
    -124.5::DOUBLE + floor(s_nationkey / 5) * 1.5::DOUBLE + (s_suppkey % 11) * 0.01::DOUBLE AS lng FROM supplier)"""

PAIRS = (
    PLACES
    + """,
pair AS (
  SELECT x.dispensary_id AS a, y.dispensary_id AS b, 2 * 3958.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(
    pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lng - x.lng) / 2), 2)))) AS miles
  FROM place x JOIN place y ON x.dispensary_id < y.dispensary_id AND abs(x.lat - y.lat) < 0.2 AND abs(x.lng - y.lng) < 0.4),
near AS (SELECT * FROM pair WHERE miles <= 10),
reach(a, b) AS (
  SELECT dispensary_id, dispensary_id FROM place
  UNION SELECT r.a, CASE WHEN n.a = r.b THEN n.b ELSE n.a END FROM reach r JOIN near n ON n.a = r.b OR n.b = r.b),
member AS (SELECT a AS dispensary_id, min(b) AS cluster_id FROM reach GROUP BY a)"""
)

EVENTS = """
ev AS (
  SELECT 'v' || user_id % 20 AS dispensary_id, user_id || '-' || event_type AS product_id, 'Brand ' || user_id % 9 AS brand, event_id AS seq,
    ts, CAST(ts AS DATE) AS day, value > 20 AS special, CASE WHEN event_id % 50 <> 0 THEN value END AS price FROM events)"""

HEALTH = """
daily AS (SELECT dispensary_id, day, count(DISTINCT product_id) AS n FROM ev GROUP BY ALL),
health AS (
  SELECT r.dispensary_id, max(n) FILTER (day = DATE '{day}') AS today_count,
    median(n) FILTER (day < DATE '{day}' AND day >= DATE '{day}' - 14) AS med,
    count(n) FILTER (day < DATE '{day}' AND day >= DATE '{day}' - 14) AS observed_days
  FROM (SELECT DISTINCT dispensary_id FROM ev{extra}) r LEFT JOIN daily d USING (dispensary_id) GROUP BY ALL),
status AS (
  SELECT dispensary_id, CASE WHEN observed_days < 5 THEN 'insufficient-history'
    WHEN today_count IS NULL OR today_count < med * 0.5::DOUBLE THEN 'suspected-extraction-failure' ELSE 'ok' END AS status,
    today_count, CASE WHEN observed_days >= 5 THEN med END AS trailing_median, observed_days FROM health)"""

ARRIVALS = (
    EVENTS
    + ","
    + HEALTH.format(day="2024-01-10", extra="")
    + """,
run AS (SELECT dispensary_id, day, row_number() OVER (PARTITION BY dispensary_id ORDER BY day) AS k FROM (SELECT DISTINCT dispensary_id, day FROM ev WHERE day <= DATE '2024-01-10')),
seen AS (SELECT dispensary_id, product_id, min(day) AS first_seen, max(day) AS last_seen FROM ev WHERE day <= DATE '2024-01-10' GROUP BY ALL),
outcome AS (
  SELECT s.*, (SELECT count(*) FROM run r WHERE r.dispensary_id = s.dispensary_id AND r.day > s.last_seen) AS absent_runs,
    CASE WHEN first_seen = DATE '2024-01-10' AND (SELECT min(day) FROM ev e WHERE e.dispensary_id = s.dispensary_id) < DATE '2024-01-10' THEN 'arrival'
      WHEN first_seen = DATE '2024-01-10' THEN 'onboarding' WHEN last_seen = DATE '2024-01-10' THEN 'present'
      WHEN t.status <> 'ok' THEN 'suppressed'
      WHEN (SELECT count(*) FROM run r WHERE r.dispensary_id = s.dispensary_id AND r.day > s.last_seen) >= 2 THEN 'dormant' ELSE 'below-threshold' END AS outcome
  FROM seen s JOIN status t USING (dispensary_id))"""
)

MEDIANS = (
    EVENTS
    + """,
price_day AS (SELECT dispensary_id, product_id, day, arg_max(price, (ts, seq)) AS v FROM ev WHERE price > 0 GROUP BY ALL),
ser AS (
  SELECT dispensary_id, product_id, count(v) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') AS observed_days,
    median(v) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') AS med, max(v) FILTER (day = DATE '2024-01-30') AS current_price
  FROM price_day GROUP BY ALL),
moved AS (
  SELECT dispensary_id, product_id, current_price, floor(med * 10000 + 0.5::DOUBLE) / 10000 AS median_price,
    floor((current_price - med) / med * 10000 + 0.5::DOUBLE) / 10000 AS pct_vs_median, observed_days,
    CASE WHEN observed_days < 7 THEN 'below-floor' WHEN current_price IS NULL THEN 'no-observation-today'
      WHEN floor((current_price - med) / med * 10000 + 0.5::DOUBLE) < 0 THEN 'below-median'
      WHEN floor((current_price - med) / med * 10000 + 0.5::DOUBLE) > 0 THEN 'above-median' ELSE 'at-median' END AS outcome FROM ser)"""
)

DEALS = """
deal AS (
  SELECT l_orderkey * 8 + l_linenumber AS deal_id, 's' || l_suppkey AS dispensary_id, l_partkey % 10 AS phrase, CAST(floor(l_discount * 100 + 0.5::DOUBLE) AS INT) AS pct,
    l_suppkey % 6 AS w, (l_orderkey + l_linenumber) % 7 AS d, CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'happy_hour' ELSE 'daily' END AS type,
    ['eighth of flower', 'pre-rolls 2 pack', 'vape carts', 'your cart storewide', 'live resin and shatter', 'edibles and drinks',
     'select brands', 'entire store', 'ounces over $100', 'something nice'][l_partkey % 10 + 1] AS words
  FROM lineitem)"""

CITES = """
chk AS (
  SELECT event_id AS check_id, event_type AS engine, 'q' || user_id % 8 AS question, ts AS checked_at, value > 20 AS cited, event_type = 'error' AS errored,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(CAST(ts AS DATE) AS VARCHAR) AS run FROM events)"""

SHARE = (
    CITES
    + """,
share AS (
  SELECT run, count(DISTINCT question) FILTER (NOT errored) AS questions, count(DISTINCT question) FILTER (NOT errored AND cited) AS cited_questions,
    count(*) FILTER (errored) AS errors, count(*) AS checks FROM chk GROUP BY run),
shares AS (SELECT *, floor(cited_questions / questions * 10000 + 0.5::DOUBLE) / 10000 AS share FROM share)"""
)

FLOORS = (
    GATED
    + ","
    + PAIRS
    + """,
inside AS (
  SELECT m.cluster_id, f.match_key, f.weight_grams, f.display_name, f.category, f.dispensary_id, f.price,
    min(f.price) OVER (PARTITION BY m.cluster_id, f.match_key, f.weight_grams) AS floor_price FROM flat f JOIN member m USING (dispensary_id)),
floors AS (
  SELECT cluster_id, match_key, weight_grams, display_name, category, floor_price,
    string_agg(dispensary_id, ',' ORDER BY dispensary_id) FILTER (price = floor_price) AS floor_stores, count(*) AS store_count_in_cluster
  FROM inside GROUP BY cluster_id, match_key, weight_grams, display_name, category, floor_price)"""
)

PRESENT = """
counts AS (SELECT dispensary_id, category, count(*) AS n FROM rec GROUP BY ALL),
present AS (SELECT dispensary_id, category FROM (SELECT *, sum(n) OVER (PARTITION BY dispensary_id) AS t FROM counts) WHERE n * 6 > t)"""

HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]+)', 1)"
KEY = rf"{HOST} || regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
RIVAL = f"({HOST} = '' OR regexp_matches({HOST}, '(^|\\.)(cheap-pills\\.example\\.com|spam-farm\\.example\\.org|example\\.net)$'))"
FETCHED = """
fetched AS (
  SELECT user_id % 40 AS store, CASE WHEN user_id % 40 % 13 <> 0 THEN max(ts) END AS fetched_at FROM events GROUP BY user_id % 40),
aged AS (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00' - fetched_at) / 3600 AS age FROM fetched)"""
ENTRIES = """
entry AS (
  SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE 's' END || s_suppkey AS dispensary_id, s_suppkey % 3 AS deals, s_suppkey % 2 = 0 AS empty FROM supplier),
outcome AS (
  SELECT *, CASE WHEN dispensary_id LIKE 'x%' THEN 'unknown' WHEN deals > 0 THEN 'ok' WHEN empty THEN 'empty' ELSE 'stale' END AS outcome FROM entry)"""

#: By window number of a deal: none, mornings, afternoons, nights, an empty one and a malformed one.
ACTIVE = """
CASE w WHEN 0 THEN d IN (2, 5) WHEN 1 THEN FALSE WHEN 2 THEN d IN (2, 5) WHEN 3 THEN FALSE WHEN 5 THEN d IN (2, 5) ELSE FALSE END"""
USABLE = "w IN (0, 1, 2, 3) AND d <> 6"

ROAD = """
2 * 3958.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat - 47.0::DOUBLE) / 2), 2)
  + cos(radians(47.0::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lng - -122.0::DOUBLE) / 2), 2)))) * 1.3::DOUBLE"""

TITLES = "pct || '% off ' || words"

TOPIC = "coalesce(['cheapest flower', 'carts', 'edibles', 'flow', 'credible', '', NULL, 'Concentrates and vapes', 'Pre-Rolls'][{n} % 9 + 1], '')"
PLACE = "coalesce(['', 'WA', 'Portland', 'Seattle', 'City 3', 'city-7', 'CITY 12', 'gotham', NULL, 'Kent, ID'][{n} % 10 + 1], '')"
#: Facts that may answer (1: floor, 2: gap, 3: drop), the categories of each topic, and what each place means.
FACTS = (
    FLOORS
    + ","
    + MEDIANS
    + """,
town AS (SELECT cluster_id, 'City ' || s_nationkey AS city, count(*) AS n FROM member JOIN place USING (dispensary_id) GROUP BY ALL),
named AS (SELECT cluster_id, arg_min(city, (-n, city)) AS label FROM town GROUP BY cluster_id HAVING sum(n) >= 2),
reg AS (SELECT min(cluster_id) AS cluster_id, replace(lower(label), ' ', '-') AS region FROM named GROUP BY label),
alias AS (SELECT lower(city) AS alias, arg_min(region, cluster_id) AS region FROM town JOIN reg USING (cluster_id) GROUP BY 1),
alive AS (SELECT cluster_id, match_key, weight_grams FROM inside i JOIN place p USING (dispensary_id) WHERE price = floor_price GROUP BY ALL HAVING max(p.balance) >= 2000),
drops AS (
  SELECT 's' || substr(m.dispensary_id, 2) AS dispensary_id, product_id AS name, pct_vs_median, current_price, median_price, CAST(floor(abs(pct_vs_median) * 100 + 0.5::DOUBLE) AS BIGINT) AS drop_percent,
    ['Flower', 'Vaporizers', 'Edible', 'Concentrate', 'Edible', 'Pre-Rolls', 'Edible'][CAST(string_split(product_id, '-')[1] AS INT) % 7 + 1] AS category FROM moved m WHERE outcome = 'below-median'),
fact AS (
  SELECT 1 AS o, 'regional-floor' AS kind, region, category, floor_price AS k1, 0 AS k2, display_name AS k3, weight_grams AS k4, '' AS k5, weight_grams, floor_price AS price, NULL::DOUBLE AS against_price, NULL::BIGINT AS drop_percent
  FROM floors JOIN alive USING (cluster_id, match_key, weight_grams) JOIN reg USING (cluster_id)
  UNION ALL SELECT 2, 'disparity', NULL, category, -spread_pct, low_price, display_name, weight_grams, '', weight_grams, low_price, high_price, NULL FROM gap WHERE high_price > low_price
  UNION ALL SELECT 3, 'own-median', region, category, pct_vs_median, 0, name, 0, dispensary_id, NULL, current_price, median_price, drop_percent
  FROM drops LEFT JOIN (SELECT * FROM member JOIN reg USING (cluster_id)) USING (dispensary_id) WHERE drop_percent >= 1),
kinds AS (SELECT unnest(['Flower', 'Vaporizers', 'Pre-Rolls', 'Concentrate', 'Edible']) AS category),
fit AS (
  SELECT '' AS topic, category FROM kinds UNION ALL SELECT unnest(['cheapest flower', 'flow', 'carts', 'edibles', 'Concentrates and vapes', 'Concentrates and vapes', 'Pre-Rolls']),
    unnest(['Flower', 'Flower', 'Vaporizers', 'Edible', 'Concentrate', 'Vaporizers', 'Pre-Rolls'])),
meant AS (
  SELECT p.place, alias.region, CASE WHEN alias.region IS NOT NULL THEN 'region' WHEN p.place IN ('WA', 'Seattle') THEN 'statewide' WHEN p.place IN ('Portland', 'Kent, ID') THEN 'outside' ELSE 'uncovered' END AS place_kind
  FROM (SELECT unnest(['', 'WA', 'Portland', 'Seattle', 'City 3', 'city-7', 'CITY 12', 'gotham', 'Kent, ID']) AS place) p LEFT JOIN alias ON replace(lower(p.place), '-', ' ') = alias.alias)"""
)
CHOSEN = """placed AS (SELECT * FROM ask JOIN meant USING (place)),
chosen AS (
  SELECT topic, place, kind, category, weight_grams, price, against_price, drop_percent FROM (
    SELECT p.topic, p.place, f.* EXCLUDE (region), row_number() OVER (PARTITION BY p.topic, p.place ORDER BY o, k1, k2, k3, k4, k5, f.category) AS n
    FROM placed p JOIN fit USING (topic) JOIN fact f ON f.category = fit.category AND (f.o = 2 OR f.region = p.region OR (f.o = 3 AND p.region IS NULL))) WHERE n = 1)"""
WORK = (
    FACTS
    + f""",
cand AS (
  SELECT page_id, url, {TOPIC.format(n="(page_id // 5)")} AS own, CASE WHEN page_id // 5 % 9 = 6 THEN 'flow' ELSE {TOPIC.format(n="(page_id // 5)")} END AS topic, {PLACE.format(n="(page_id // 3)")} AS place, page_id % 5 AS s
  FROM pages WHERE NOT {RIVAL}),
ask AS (SELECT DISTINCT topic, place FROM cand), {CHOSEN},
work AS (
  SELECT page_id, url, kind, category, floor((CASE kind WHEN 'regional-floor' THEN 300 WHEN 'disparity' THEN 200 + least((against_price - price) / price * 100, 100) ELSE 100 END
      + CASE WHEN own <> '' AND (own, category) IN (SELECT (topic, category) FROM fit) THEN 50 ELSE 0 END
      + CASE WHEN page_id % 11 <> 0 THEN greatest(0, 40 - 0.4::DOUBLE * (page_id % 120)) ELSE 0 END) * 10000 + 0.5::DOUBLE) / 10000 AS fit_score
  FROM cand JOIN chosen USING (topic, place) JOIN meant USING (place)
  WHERE place_kind IN ('region', 'statewide') OR (place_kind = 'uncovered' AND (s = 0 OR (s = 1 AND EXISTS (FROM alias WHERE alias = 'city 4')))))"""
)

ORACLES = {
    "d1_disparities": f"WITH {GATED} SELECT match_key, display_name, category, weight_grams, low_price, high_price, spread, spread_pct, stores, stores_carrying FROM gap",
    "d1_gate_counters": f"""WITH {GATED} SELECT count(*) AS total_records, count(*) FILTER (reason = 'category') AS non_comparable_category_count,
        count(*) FILTER (reason = 'flag') AS excluded_flag_count, CAST(0 AS BIGINT) AS unmatched_count, count(*) FILTER (reason = 'stale') AS stale_records,
        (SELECT count(DISTINCT (dispensary_id, product_id)) FROM offer) AS placed_records FROM gate""",
    "d1a_anchor_day": f"WITH {RECORDS} SELECT CAST(max(CAST(observed_at AS DATE)) AS VARCHAR) AS anchor FROM rec WHERE CAST(observed_at AS DATE) <= DATE '2001-06-30'",
    "d2_deal_links": f"""WITH {RECORDS}, {DEALS},
        scope AS (SELECT *, CASE phrase WHEN 0 THEN 'category' WHEN 1 THEN 'category' WHEN 2 THEN 'category' WHEN 3 THEN 'storewide' WHEN 4 THEN 'unresolved'
            WHEN 5 THEN 'unsupported-category' WHEN 6 THEN 'brand' WHEN 7 THEN 'storewide' WHEN 8 THEN 'category' ELSE 'unresolved' END AS kind,
          CASE phrase WHEN 0 THEN 'Flower' WHEN 1 THEN 'Pre-Rolls' WHEN 2 THEN 'Vaporizers' WHEN 8 THEN 'Flower' END AS category,
          CASE phrase WHEN 0 THEN 3.5::DOUBLE WHEN 8 THEN 28.0::DOUBLE END AS weight_grams FROM deal),
        stock AS (SELECT dispensary_id, category AS c, weight_grams AS g, flagged, count(*) AS n FROM rec WHERE category IN ('Flower', 'Vaporizers', 'Pre-Rolls') AND coalesce(special_price, base_price) > 0 GROUP BY ALL)
        SELECT s.deal_id, s.dispensary_id, s.kind, s.category, s.weight_grams, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS linked
        FROM scope s LEFT JOIN stock k ON k.dispensary_id = s.dispensary_id AND (s.kind = 'storewide' OR s.kind = 'category' AND s.category = k.c
          AND (s.weight_grams IS NULL OR NOT k.flagged AND k.g = s.weight_grams)) GROUP BY s.deal_id, s.dispensary_id, s.kind, s.category, s.weight_grams""",
    "d2_scope_products": f"""WITH {RECORDS}, {DEALS},
        scope AS (SELECT DISTINCT dispensary_id, CASE WHEN phrase IN (3, 7) THEN 'storewide' ELSE 'category' END AS kind,
            CASE phrase WHEN 0 THEN 'Flower' WHEN 1 THEN 'Pre-Rolls' WHEN 2 THEN 'Vaporizers' WHEN 8 THEN 'Flower' END AS category,
            CASE phrase WHEN 0 THEN 3.5::DOUBLE WHEN 8 THEN 28.0::DOUBLE END AS weight_grams FROM deal WHERE phrase IN (0, 1, 2, 3, 7, 8)),
        priced AS (SELECT dispensary_id, product_id, category AS c, weight_grams AS g, flagged FROM rec WHERE coalesce(special_price, base_price) > 0 AND category IN ('Flower', 'Vaporizers', 'Pre-Rolls'))
        SELECT s.*, p.product_id FROM scope s JOIN priced p ON p.dispensary_id = s.dispensary_id
          AND (s.kind = 'storewide' OR p.c = s.category AND (s.weight_grams IS NULL OR p.g = s.weight_grams AND NOT p.flagged))""",
    "d3_extraction_health": f"WITH {EVENTS}, {HEALTH.format(day='2024-01-30', extra=' UNION SELECT chr(118) || chr(45) || chr(110) || chr(111) || chr(110) || chr(101)')} SELECT * FROM status",
    "d4_special_states": f"""WITH {EVENTS}, last AS (SELECT dispensary_id, product_id, day, arg_max(special, seq) AS v FROM ev WHERE day <= DATE '2024-01-30' GROUP BY ALL),
        two AS (SELECT dispensary_id, product_id, max(v) FILTER (day = DATE '2024-01-30') AS now, arg_max(v, day) FILTER (day < DATE '2024-01-30') AS before FROM last GROUP BY ALL)
        SELECT dispensary_id, product_id, CASE WHEN now IS NULL THEN 'gap' WHEN before IS NULL THEN 'first' WHEN now = before THEN 'unchanged'
          WHEN now THEN 'special-start' ELSE 'special-end' END AS state FROM two""",
    "d5_rollup_category": f"""WITH {GATED} SELECT category, count(*) AS disparity_count, floor(avg(spread_pct) * 100 + 0.5::DOUBLE) / 100 AS avg_spread_pct,
        (SELECT count(DISTINCT dispensary_id) FROM flat f WHERE f.category = g.category) AS distinct_stores FROM gap g GROUP BY category""",
    "d5_rollup_store": f"""WITH {GATED}, {PLACES} SELECT dispensary_id, count(*) AS disparity_count, count(*) FILTER (high_price > low_price AND price = low_price) AS times_cheapest,
        count(*) FILTER (high_price > low_price AND price = high_price) AS times_priciest, floor(any_value(lat) * 10000 + 0.5::DOUBLE) / 10000 AS lat,
        floor(any_value(lng) * 10000 + 0.5::DOUBLE) / 10000 AS lng FROM flat JOIN place USING (dispensary_id) GROUP BY dispensary_id""",
    "d6_brand_personas": f"""WITH {EVENTS}, last AS (SELECT dispensary_id, product_id, any_value(brand) AS brand, day, arg_max(special, seq) AS v FROM ev WHERE day <= DATE '2024-01-30' GROUP BY dispensary_id, product_id, day),
        b AS (SELECT lower(brand) AS brand_key, brand AS display_brand, count(DISTINCT (dispensary_id, product_id)) AS product_count, count(*) AS observed_product_days,
          count(*) FILTER (v) AS special_product_days FROM last GROUP BY brand)
        SELECT *, CASE WHEN observed_product_days >= 10 THEN floor(special_product_days / observed_product_days * 10000 + 0.5::DOUBLE) / 10000 END AS special_day_fraction,
          CASE WHEN observed_product_days < 10 THEN 'insufficient-history' WHEN special_product_days / observed_product_days >= 0.95::DOUBLE THEN 'always-on-special'
            WHEN special_product_days / observed_product_days <= 0.05::DOUBLE THEN 'never-discounted' ELSE 'intermittently-discounted' END AS persona FROM b""",
    "d7_brand_availability": f"""WITH {RECORDS} SELECT brand_key, count(*) AS product_count, array_to_string(list_sort(list(DISTINCT dispensary_id)), ',') AS stores_carrying,
        array_to_string(list_sort(list(DISTINCT p_size)), ',') AS tiers FROM rec WHERE brand IS NOT NULL GROUP BY brand_key""",
    "d7_cheapest_cells": f"""WITH {RECORDS}, o AS (SELECT *, coalesce(special_price, base_price) AS price FROM rec WHERE brand IS NOT NULL),
        b AS (SELECT brand_key, match_key, weight_grams, dispensary_id, min(price) AS price, arg_min(name, (price, product_id)) AS name FROM o WHERE price > 0 GROUP BY ALL),
        c AS (SELECT *, min(price) OVER (PARTITION BY brand_key, match_key, weight_grams) AS low_price FROM b)
        SELECT brand_key, match_key, weight_grams, low_price, count(*) AS stores_carrying,
          string_agg(dispensary_id, ',' ORDER BY dispensary_id) FILTER (price = low_price) AS cheapest_stores, arg_min(name, (price, dispensary_id)) AS display_name
        FROM c GROUP BY brand_key, match_key, weight_grams, low_price HAVING count(*) >= 2""",
    "d8_new_arrivals": f"WITH {ARRIVALS} SELECT dispensary_id, product_id, CAST(first_seen AS VARCHAR) AS first_seen FROM outcome WHERE outcome = 'arrival'",
    "d8_dormant": f"WITH {ARRIVALS} SELECT dispensary_id, product_id, CAST(last_seen AS VARCHAR) AS last_seen, absent_runs FROM outcome WHERE outcome = 'dormant'",
    "d8_counters": f"WITH {ARRIVALS} SELECT outcome, count(*) AS n FROM outcome GROUP BY outcome",
    "d9_price_vs_median": f"WITH {MEDIANS} SELECT * EXCLUDE (outcome) FROM moved WHERE outcome IN ('below-median', 'above-median')",
    "d9_counters": f"WITH {MEDIANS} SELECT outcome, count(*) AS n FROM moved GROUP BY outcome",
    "d10_delivered_offers": f"""WITH {GATED}, {PLACES} SELECT dispensary_id, match_key, display_name, category, weight_grams, price, floor(price / weight_grams * 10000 + 0.5::DOUBLE) / 10000 AS price_per_gram,
        floor(lat * 10000 + 0.5::DOUBLE) / 10000 AS lat, floor(lng * 10000 + 0.5::DOUBLE) / 10000 AS lng FROM flat JOIN place USING (dispensary_id)""",
    "d11_floors": f"WITH RECURSIVE {FLOORS} SELECT * FROM floors",
    "d11_gaps": f"""WITH RECURSIVE {RECORDS}, {PAIRS}, {PRESENT},
        ok AS (SELECT cluster_id FROM member JOIN place USING (dispensary_id) GROUP BY cluster_id HAVING min(balance) >= -800),
        want AS (SELECT cluster_id, category FROM ok, (SELECT DISTINCT category FROM present))
        SELECT cluster_id, category FROM want EXCEPT SELECT cluster_id, category FROM present JOIN member USING (dispensary_id)""",
    "d12_clusters": f"WITH RECURSIVE {PAIRS} SELECT cluster_id, dispensary_id FROM member",
    "d12_centroids": f"""WITH RECURSIVE {PAIRS} SELECT cluster_id, count(*) AS store_count, floor(floor(avg(lat) * 10000 + 0.5::DOUBLE) / 10000 * 100 + 0.5::DOUBLE) / 100 AS centroid_lat,
        floor(floor(avg(lng) * 10000 + 0.5::DOUBLE) / 10000 * 100 + 0.5::DOUBLE) / 100 AS centroid_lng FROM member JOIN place USING (dispensary_id) GROUP BY cluster_id""",
    "d13_regions": f"""WITH RECURSIVE {PAIRS}, c AS (SELECT cluster_id, 'City ' || s_nationkey AS city, count(*) AS n FROM member JOIN place USING (dispensary_id) GROUP BY ALL),
        l AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS store_count, arg_min(city, (-n, city)) AS label FROM c GROUP BY cluster_id HAVING sum(n) >= 2),
        r AS (SELECT *, replace(lower(label), ' ', '-') AS slug, row_number() OVER (PARTITION BY label ORDER BY cluster_id) AS k FROM l)
        SELECT cluster_id, store_count, label, slug FROM r WHERE k = 1""",
    "d13_standing_floors": f"""WITH RECURSIVE {FLOORS}, held AS (SELECT i.*, p.balance < 2000 AS dead FROM inside i JOIN place p USING (dispensary_id)),
        k AS (SELECT cluster_id, match_key, weight_grams, display_name, category, floor_price, count(*) AS store_count_in_cluster,
          string_agg(dispensary_id, ',' ORDER BY dispensary_id) FILTER (price = floor_price AND NOT dead) AS alive,
          string_agg(dispensary_id, ',' ORDER BY dispensary_id) FILTER (price = floor_price) AS holders FROM held GROUP BY cluster_id, match_key, weight_grams, display_name, category, floor_price)
        SELECT * EXCLUDE (alive, holders), coalesce(alive, holders) AS floor_stores, alive IS NULL AS stale FROM k""",
    "w1_day_walk": f"""WITH {EVENTS}, last AS (SELECT product_id, day, arg_max(special, seq) AS value FROM ev GROUP BY ALL),
        days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day),
        grid AS (SELECT p.product_id, d.day, l.value FROM (SELECT DISTINCT product_id FROM last) p CROSS JOIN days d LEFT JOIN last l ON l.product_id = p.product_id AND l.day = d.day),
        prior AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM grid)
        SELECT product_id, CAST(day AS VARCHAR) AS day, CASE WHEN value IS NULL THEN 'gap' WHEN b IS NULL THEN 'first' WHEN value = b THEN 'unchanged' ELSE 'changed' END AS status,
          value, CASE WHEN value <> b THEN b END AS previous FROM prior""",
    "w11_session_runs": f"""WITH {CITES}, t AS (SELECT *, CASE WHEN lag(checked_at) OVER w IS NULL OR checked_at - lag(checked_at) OVER w > INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS s FROM chk
          WINDOW w AS (PARTITION BY engine ORDER BY checked_at, check_id)),
        r AS (SELECT engine, CAST(sum(s) OVER (PARTITION BY engine ORDER BY checked_at, check_id) AS BIGINT) AS run FROM t)
        SELECT engine, run, count(*) AS checks FROM r GROUP BY ALL""",
    "w12_trend": f"""WITH {SHARE} SELECT run, share, lag(share) OVER (ORDER BY run) AS previous,
        floor((share - lag(share) OVER (ORDER BY run)) * 10000 + 0.5::DOUBLE) / 10000 AS delta FROM shares""",
    "w13_first_citations": f"WITH {CITES} SELECT engine, question, min(run) AS first_run FROM chk WHERE cited AND NOT errored GROUP BY ALL",
    "a14_citation_share": f"WITH {SHARE} SELECT * FROM shares",
    "a15_rival_rank": f"""WITH {CITES}, d AS (SELECT check_id, 'site' || k % 17 || '.example' AS domain FROM chk WHERE NOT errored UNION SELECT check_id, 'site' || k % 5 || '.example' FROM chk WHERE NOT errored)
        SELECT domain, count(*) AS n FROM d WHERE domain <> 'site0.example' GROUP BY domain""",
    "a16_engine_summary": f"WITH {CITES} SELECT engine, count(*) AS checks, count(*) FILTER (cited AND NOT errored) AS cited, count(*) FILTER (errored) AS errors FROM chk GROUP BY engine",
    "o2_top_gaps": f"WITH {GATED} SELECT match_key, weight_grams, low_price, high_price, spread FROM gap WHERE high_price > low_price ORDER BY spread DESC, match_key, weight_grams LIMIT 15",
    "o5_store_drops": f"""WITH {MEDIANS}, r AS (SELECT dispensary_id, product_id, pct_vs_median, CAST(floor(abs(pct_vs_median) * 100 + 0.5::DOUBLE) AS BIGINT) AS drop_percent FROM moved WHERE outcome = 'below-median'),
        k AS (SELECT *, row_number() OVER (PARTITION BY dispensary_id ORDER BY pct_vs_median, product_id) AS place FROM r WHERE drop_percent <> 0) SELECT * FROM k WHERE place <= 12""",
    "o7_deal_feed": f"""WITH {DEALS}, {PLACES}, act AS (SELECT *, CASE WHEN type = 'happy_hour' AND w <> 0 THEN 0 WHEN type = 'happy_hour' THEN 1 ELSE 2 END AS tier,
          CASE WHEN type = 'happy_hour' AND w = 2 THEN 60 WHEN type = 'happy_hour' THEN 0 ELSE -pct END AS v FROM deal WHERE {USABLE} AND {ACTIVE}),
        r AS (SELECT *, row_number() OVER (PARTITION BY dispensary_id ORDER BY tier, v, deal_id) AS deal_rank FROM act),
        h AS (SELECT r.*, CASE WHEN balance > 0 THEN floor(({ROAD}) * 10000 + 0.5::DOUBLE) / 10000 END AS miles FROM r JOIN place USING (dispensary_id) WHERE deal_rank = 1),
        s AS (SELECT dispensary_id, row_number() OVER (ORDER BY miles NULLS LAST, tier, v, deal_id) AS store_rank FROM h)
        SELECT dispensary_id, deal_id, deal_rank, store_rank FROM r JOIN s USING (dispensary_id)""",
    "o14_endpoints": f"""WITH {GATED} SELECT match_key, weight_grams, CASE WHEN any_value(high_price) > any_value(low_price) THEN min(dispensary_id) FILTER (price = low_price) END AS low_store,
        CASE WHEN any_value(high_price) > any_value(low_price) THEN min(dispensary_id) FILTER (price = high_price) END AS high_store FROM flat GROUP BY match_key, weight_grams""",
    "j6_geo_lookup": f"""WITH {PLACES} SELECT dispensary_id, CASE WHEN balance < 7000 AND NOT balance > 6000 THEN floor((lat + 0.5::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000 WHEN balance > 5000 THEN floor(lat * 10000 + 0.5::DOUBLE) / 10000 END AS lat,
        CASE WHEN balance < 7000 AND NOT balance > 6000 THEN floor(lng * 10000 + 0.5::DOUBLE) / 10000 WHEN balance > 5000 THEN floor(lng * 10000 + 0.5::DOUBLE) / 10000 END AS lng
        FROM place WHERE balance > 0 OR balance < 7000 AND NOT balance > 6000""",
    "j9_pairs_within_radius": f"WITH RECURSIVE {PAIRS} SELECT a, b, floor(miles * 10000 + 0.5::DOUBLE) / 10000 AS miles FROM near",
    "m2_unit_prices": f"""WITH {RECORDS} SELECT dispensary_id, product_id, floor(base_price / weight_grams * 100 + 0.5::DOUBLE) / 100 AS price_per_gram,
        floor(special_price / weight_grams * 100 + 0.5::DOUBLE) / 100 AS special_price_per_gram, floor(base_price / 5 * 100 + 0.5::DOUBLE) / 100 AS price_per_item FROM rec""",
    "m5_distances": f"""WITH {PLACES} SELECT dispensary_id, floor(({ROAD}) * 10000 + 0.5::DOUBLE) / 10000 AS road_miles,
        floor(({ROAD}) * 2 * (4.5::DOUBLE / 25) * 10000 + 0.5::DOUBLE) / 10000 AS gas_cost FROM place""",
    "m8_delivered_winner": f"""WITH {GATED}, {PLACES}, t AS (SELECT match_key, weight_grams, dispensary_id, price, price + ({ROAD}) * 2 * (4.5::DOUBLE / 25) AS total FROM flat JOIN place USING (dispensary_id)),
        k AS (SELECT *, row_number() OVER (PARTITION BY match_key, weight_grams ORDER BY total, dispensary_id) AS n FROM t)
        SELECT match_key, weight_grams, dispensary_id, price, floor(total * 100 + 0.5::DOUBLE) / 100 AS total FROM k WHERE n = 1""",
    "m11_discount_tiers": f"WITH {DEALS} SELECT CASE WHEN pct * 4 >= 30 THEN 'high' WHEN pct * 4 >= 15 THEN 'mid' WHEN pct > 0 THEN 'low' END AS tier, count(*) AS n FROM deal GROUP BY 1",
    "s3_canonical_weight": """WITH l AS (SELECT p_partkey, ['1/8oz', '1/4oz', '1/2oz', '1oz', '3.5g', '1g', '100mg', '2', '1/0oz', '4mg', '3.6g', 'abc', '28g'][p_partkey % 13 + 1] AS label FROM part)
        SELECT p_partkey, label, CAST(CASE label WHEN '1/8oz' THEN 3.54 WHEN '1/4oz' THEN 7.09 WHEN '1/2oz' THEN 14.17 WHEN '1oz' THEN 28.35 WHEN '3.5g' THEN 3.5 WHEN '1g' THEN 1 WHEN '100mg' THEN 0.1
          WHEN '2' THEN 2 WHEN '4mg' THEN 0.004 WHEN '3.6g' THEN 3.6 WHEN '28g' THEN 28 END AS DOUBLE) AS grams,
          CAST(CASE label WHEN '1/8oz' THEN 3.5 WHEN '1/4oz' THEN 7 WHEN '1/2oz' THEN 14 WHEN '1oz' THEN 28 WHEN '3.5g' THEN 3.5 WHEN '1g' THEN 1 WHEN '100mg' THEN 0.1 WHEN '2' THEN 2 WHEN '3.6g' THEN 3.6
          WHEN '28g' THEN 28 END AS DOUBLE) AS canonical FROM l""",
    "s7_match_key": f"""WITH {CATALOG} SELECT product_id, brand_key, coalesce(brand_key, '') || '|' || array_to_string(list_sort(list_concat(string_split(name, ' '), CASE WHEN brand_key = 'brand 707' THEN ['og', 'og'] ELSE ['707', 'og', 'og'] END)), ' ')
        || '|hybrid|' || replace(lower(category), '-', ' ') || CASE WHEN category = 'Concentrate' THEN '|' || form ELSE '' END AS match_key FROM keyed""",
    "s9_descriptions": r"""WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[\x00-\x20\x7F\x{A0}]+', ' ', 'g')) AS s FROM documents),
        b AS (SELECT *, left(s, 160) AS h, regexp_extract(left(s, 160), '(?s)^(.+) [^ ]*$', 1) AS w FROM a)
        SELECT doc_id, CASE WHEN regexp_matches(s, '(?i)\b(?:cure|cures|heals|healing|relieves pain|pain relief|treats anxiety|medical benefit|therapeutic|medicinal|kid|kids|cartoon)\b') THEN ''
          WHEN length(s) <= 160 THEN s WHEN w <> '' THEN rtrim(w) ELSE rtrim(h) END AS description FROM b""",
    "s12_deal_scope": f"""WITH {DEALS} SELECT deal_id, ['category', 'category', 'category', 'storewide', 'unresolved', 'unsupported-category', 'brand', 'storewide', 'category', 'unresolved'][phrase + 1] AS kind,
        ['Flower', 'Pre-Rolls', 'Vaporizers', NULL, NULL, NULL, NULL, NULL, 'Flower', NULL][phrase + 1] AS category, CASE phrase WHEN 0 THEN 3.5::DOUBLE WHEN 8 THEN 28.0::DOUBLE END AS weight_grams, CASE WHEN phrase = 5 THEN 'edibles' END AS targeted FROM deal""",
    "s13_deal_icons": f"""WITH {DEALS} SELECT deal_id, ['bud', 'joint-double', 'vape', 'store-wide', 'shatter', 'edible,drink', 'special-pricing', 'store-wide', 'bud', 'special-pricing'][phrase + 1] AS icons,
        ['bud', 'joint-single', 'vape', 'store-wide', 'shatter', 'edible,drink', 'special-pricing', 'store-wide', 'bud', 'special-pricing'][phrase + 1] AS categories FROM deal""",
    "s16_deal_titles": f"WITH {DEALS} SELECT deal_id, words AS title FROM deal",
    "s19_deal_blocks": f"""WITH {DEALS}, b AS (SELECT dispensary_id, type, words AS title, min(deal_id) AS first_deal, count(*) AS deals, min(pct) AS lo, max(pct) AS hi FROM deal GROUP BY dispensary_id, type, words)
        SELECT dispensary_id, type, title, first_deal, deals, CASE WHEN hi <= 0 THEN NULL WHEN lo = hi THEN lo || '%' ELSE lo || '–' || hi || '%' END AS pct_label FROM b""",
    "s20_slugs": f"WITH {CATALOG} SELECT product_id, regexp_replace(regexp_replace(lower(concat_ws(' & ', brand, name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM cat",
    "s21_cities": f"WITH {PLACES} SELECT dispensary_id, 'City ' || s_nationkey AS city FROM place",
    "s25_domains": f"SELECT nullif({HOST}, '') AS domain, count(*) AS n FROM pages GROUP BY 1",
    "s26_mention_keys": f"SELECT page_id, {KEY} AS mention_key FROM pages",
    "s28_inventory_tokens": """SELECT DISTINCT p_name AS token FROM part UNION SELECT DISTINCT t FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part) WHERE length(t) >= 3""",
    "f1_active_deals": f"WITH {DEALS} SELECT deal_id, dispensary_id FROM deal WHERE w IN (0, 1, 2, 3) AND {ACTIVE}",
    "f5_usable_deals": f"WITH {DEALS} SELECT deal_id, {TITLES} AS description FROM deal WHERE {USABLE}",
    "f21_selection": f"WITH {DEALS} SELECT deal_id FROM deal WHERE phrase IN (2, 3, 7)",
    "f9_store_status": f"""WITH {FETCHED} SELECT store, CASE WHEN fetched_at IS NULL THEN 'failed' WHEN age <= 3 THEN 'ok' ELSE 'stale' END AS status, fetched_at IS NULL OR age > 24 AS expired,
        CASE WHEN fetched_at IS NULL THEN 'never-derived' WHEN age < -6 THEN 'future-skew' WHEN age > 50 THEN 'stale' WHEN age <= 28 THEN 'fresh' ELSE 'late' END AS run FROM aged""",
    "f24_off_channel": f"SELECT page_id FROM pages WHERE {RIVAL}",
    "f26_prefilter": """WITH t AS (SELECT conv_id || '-' || turn AS id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM conversations),
        m AS (SELECT id, CASE WHEN contains(s, ' the ') THEN 'the' WHEN contains(s, ' der ') THEN 'der' WHEN contains(s, ' la ') THEN 'la' END AS geo,
          CASE WHEN contains(s, ' is ') THEN 'is' WHEN contains(s, ' und ') THEN 'und' WHEN contains(s, ' de ') THEN 'de' END AS term FROM t)
        SELECT *, CASE WHEN geo IS NULL THEN 'no place' WHEN term IS NULL THEN 'no product' END AS reason FROM m""",
    "f32_alert": f"""WITH {FETCHED}, c AS (SELECT count(*) FILTER (age <= 3) AS fresh_count, count(*) FILTER (age > 6) AS stale_count FROM aged)
        SELECT *, fresh_count = 0 AS total_failure, fresh_count = 0 OR stale_count > 0 AS alert FROM c""",
    "src16_categories": f"WITH {CATALOG} SELECT product_id, category FROM cat",
    "src17_brand_slugs": f"""WITH {CATALOG} SELECT product_id, CASE WHEN brand IS NULL THEN '' ELSE 'Brand ' || split_part(brand, '#', 2) || ' ' END || upper(left(name, 1)) || substr(split_part(name, ' ', 1), 2) AS brand FROM cat""",
    "src22_weekdays": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'tuesday,saturday' WHEN 1 THEN 'sunday' ELSE 'everyday' END AS days FROM part",
    "src27_clock_windows": """WITH t AS (SELECT p_partkey, p_size % 12 + 1 AS a, (p_size + 2) % 12 + 1 AS b, CASE WHEN p_size % 2 = 0 THEN 12 ELSE 0 END AS h FROM part)
        SELECT p_partkey, lpad(CAST(a % 12 + h AS VARCHAR), 2, '0') || ':30' AS start_time, lpad(CAST(b % 12 + h AS VARCHAR), 2, '0') || ':00' AS end_time FROM t""",
    "src29_page_titles": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&quot;', '"'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS title FROM pages""",
    "src31_fallback": f"""WITH {EVENTS}, a AS (SELECT dispensary_id, product_id, count(*) AS n, 'site' AS source FROM ev WHERE special GROUP BY dispensary_id, product_id)
        SELECT * FROM a UNION ALL SELECT dispensary_id, product_id, count(*), 'menu' FROM ev WHERE product_id NOT IN (SELECT product_id FROM a) GROUP BY dispensary_id, product_id""",
    "src40_places": f"""WITH {PLACES} SELECT dispensary_id, CASE WHEN balance > 3000 THEN floor(lat * 10000 + 0.5::DOUBLE) / 10000 WHEN lat + 1 BETWEEN 45.5 AND 49.0 AND lng BETWEEN -124.85 AND -116.9 THEN floor((lat + 1) * 10000 + 0.5::DOUBLE) / 10000 END AS lat,
        CASE WHEN balance > 3000 OR lat + 1 BETWEEN 45.5 AND 49.0 AND lng BETWEEN -124.85 AND -116.9 THEN floor(lng * 10000 + 0.5::DOUBLE) / 10000 END AS lng FROM place""",
    "js1_loose_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events",
    "snk2_append": f"WITH {EVENTS} SELECT product_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') AS observed_at, min(seq) AS obs_seq FROM ev WHERE day > DATE '2024-01-20' GROUP BY product_id, ts",
    "snk7_ingest_merge": f"""WITH {PLACES}, {ENTRIES}, o AS (SELECT * FROM outcome WHERE deals < 2)
        SELECT dispensary_id, CASE WHEN o.outcome IN ('ok', 'empty') THEN '2024-01-30' ELSE '2024-01-01' END AS last_fetched_at, coalesce(o.outcome = 'stale', FALSE) AS stale FROM place LEFT JOIN o USING (dispensary_id)""",
    "snk7_outcomes": f"WITH {ENTRIES} SELECT outcome, count(*) AS n FROM outcome GROUP BY outcome",
    "src2_window": f"""WITH {RECORDS} SELECT dispensary_id, product_id, name, category, seq AS obs_seq, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, base_price, special_price
        FROM obs JOIN cat USING (partkey) WHERE observed_at >= TIMESTAMP '2001-06-01'""",
    "jes5_normalize": f"""WITH {CATALOG}, n AS (SELECT c.*, p_retailprice AS price, CASE WHEN c.partkey % 3 = 0 THEN 2 WHEN category = 'Pre-Rolls' THEN 1 END AS pack,
          category <> 'Edible' AS weighed, c.partkey % 4 = 0 AS two, c.p_size * CASE WHEN c.partkey % 5 = 0 THEN 900.0::DOUBLE ELSE 1000.0::DOUBLE END AS net, c.p_size * 1000.0::DOUBLE AS total
          FROM cat c JOIN part p ON p.p_partkey = c.partkey)
        SELECT product_id, pack AS pack_count, concat_ws(',', CASE WHEN category = 'Pre-Rolls' AND partkey % 3 <> 0 THEN 'assumed-single' END,
            CASE WHEN weighed AND NOT two AND pack IS NOT NULL AND (abs(net - total) / greatest(net, total) > 0.02::DOUBLE OR abs(1000.0::DOUBLE * pack - total) / greatest(1000.0::DOUBLE * pack, total) > 0.02::DOUBLE) THEN 'weight-mismatch' END,
            CASE WHEN weighed AND two AND pack > 1 THEN 'unreconciled-pack' END) AS flags,
          CASE WHEN weighed THEN floor(price / p_size * 100 + 0.5::DOUBLE) / 100 END AS price_per_gram, CASE WHEN category = 'Pre-Rolls' THEN floor(price / pack * 100 + 0.5::DOUBLE) / 100 END AS price_per_item FROM n""",
    "t3_category_gap": f"""WITH {RECORDS}, {PRESENT} SELECT dispensary_id, category FROM (SELECT DISTINCT dispensary_id FROM present), (SELECT DISTINCT category FROM present)
        EXCEPT SELECT dispensary_id, category FROM present""",
    "t5_sitemap": f"""WITH {GATED}, {PLACES} SELECT DISTINCT '/compare/' || lower(category) AS path FROM gap UNION SELECT '/store/' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') FROM place""",
    "x1_select_fact": f"""WITH RECURSIVE {FACTS}, ask AS (SELECT DISTINCT {TOPIC.format(n="page_id")} AS topic, {PLACE.format(n="page_id")} AS place FROM pages), {CHOSEN}
        SELECT topic, place, place_kind, region, CASE WHEN refused IS NULL THEN coalesce(kind, 'none') ELSE 'none' END AS kind,
          CASE WHEN refused IS NULL THEN category END AS category, CASE WHEN refused IS NULL THEN weight_grams END AS weight_grams, CASE WHEN refused IS NULL THEN price END AS price,
          CASE WHEN refused IS NULL THEN against_price END AS against_price, CASE WHEN refused IS NULL THEN drop_percent END AS drop_percent,
          coalesce(refused, CASE WHEN kind IS NULL THEN 'no fact' END) AS reason
        FROM (SELECT *, CASE WHEN place_kind = 'outside' THEN 'outside the state' WHEN place_kind = 'uncovered' AND place <> '' THEN 'unknown place' END AS refused
          FROM placed LEFT JOIN chosen USING (topic, place))""",
    "x3_paired": f"WITH RECURSIVE {WORK} SELECT page_id, kind, category, fit_score FROM work",
    "x3_worklist": f"WITH RECURSIVE {WORK} SELECT url, kind, fit_score FROM work ORDER BY fit_score DESC, url LIMIT 10",
    "x3_counters": f"WITH RECURSIVE {WORK}, k AS (SELECT count(*) AS kept FROM work) SELECT (SELECT count(*) FROM pages) AS scanned, kept, CASE WHEN kept = 0 THEN 'none fits' END AS reason FROM k",
    "j18_brand_facts": f"""WITH {GATED} SELECT match_key, weight_grams, CASE length(display_name) % 4 WHEN 0 THEN display_name LIKE '% ring' WHEN 1 THEN display_name LIKE '% bolt' ELSE FALSE END AS concerns FROM gap""",
    "st4_stream_first_seen": "SELECT DISTINCT user_id FROM events",
    "st5_stream_sessions": """WITH t AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events),
        r AS (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM t)
        SELECT event_type, CAST(min(ts) AS VARCHAR) AS started, count(*) AS checks FROM r GROUP BY event_type, run""",
    "st6_stream_presence": f"WITH {EVENTS} SELECT CAST(day AS VARCHAR) AS day, dispensary_id, count(DISTINCT product_id) AS products, count(*) AS observations FROM ev GROUP BY ALL",
    "x4_chase_list": f"""WITH known AS (SELECT {KEY} AS key FROM pages WHERE page_id % 10 = 0),
        m AS (SELECT {KEY} AS key, {HOST} AS host, url, CASE WHEN page_id % 2 = 0 THEN page_id END AS posted, row_number() OVER (PARTITION BY {KEY} ORDER BY url) AS n FROM pages
          WHERE page_id % 3 = 0 AND NOT {RIVAL} AND NOT regexp_matches({HOST}, '(^|\\.)example\\.org$') AND {HOST} <> 'therha.example.com' AND {KEY} NOT IN (SELECT key FROM known))
        SELECT key, posted FROM m WHERE n = 1""",
    "x5_alerts": """WITH c AS (SELECT user_id AS post_id, event_id AS position, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events WHERE user_id % 9 <> 0),
        f AS (SELECT *, k % 8 AS intent, row_number() OVER (PARTITION BY post_id ORDER BY position) AS n FROM c WHERE k % 8 BETWEEN 1 AND 6 AND k >= 70 AND event_type <> 'error')
        SELECT post_id, position, intent FROM f WHERE n = 1""",
}
ORACLES["d2_link_counters"] = (
    "WITH links AS ("
    + ORACLES["d2_deal_links"]
    + """) SELECT count(*) AS total_deals, count(*) FILTER (kind = 'storewide') AS storewide_count, count(*) FILTER (kind = 'category') AS category_count,
        count(*) FILTER (kind = 'brand') AS brand_count, count(*) FILTER (kind = 'unsupported-category') AS unsupported_count, count(*) FILTER (kind = 'unresolved') AS unresolved_count,
        count(*) FILTER (kind IN ('storewide', 'category') AND linked = 0) AS zero_match_count, CAST(sum(linked) AS BIGINT) AS linked_products FROM links"""
)
ORACLES["d4_special_counters"] = "WITH s AS (" + ORACLES["d4_special_states"] + ") SELECT state, count(*) AS n FROM s GROUP BY state"
