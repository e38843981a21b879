"""SQL that gives the rows of the further queries, written for DuckDB and apart from them."""

from __future__ import annotations

from .oracles import ACTIVE, CATALOG, CITES, DEALS, EVENTS, FETCHED, FLOORS, GATED, HOST, MEDIANS, PAIRS, PLACES, RECORDS, ROAD, SHARE, USABLE
from .oracles import ORACLES as FIRST

ORACLES = {
    "f3_open_windows": f"WITH {DEALS} SELECT deal_id FROM deal WHERE w IN (0, 2, 4, 5)",
    "f14_price_usability": f"WITH {EVENTS} SELECT dispensary_id, count(*) FILTER (price > 0) AS usable, count(*) FILTER (price IS NULL OR price <= 0) AS unusable FROM ev GROUP BY 1",
    "f15_renderable": f"WITH {GATED} SELECT category, count(*) AS n FROM gap GROUP BY category",
    "f22_near_stores": f"WITH {PLACES} SELECT dispensary_id FROM place WHERE balance <= 0 OR ({ROAD}) <= 150",
    "f23_expired_split": f"WITH {FETCHED} SELECT fetched_at IS NULL OR age > 24 AS expired, count(*) AS stores FROM aged GROUP BY 1",
    "f29_crawlers": "SELECT p_partkey, ['Googlebot', 'GPTBot', NULL, 'spider', 'Applebot-Extended', 'Applebot', NULL][p_partkey % 7 + 1] AS agent FROM part",
    "f30_probes": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'skip' ELSE ['ok', 'ok', 'broken', 'broken', 'unknown', 'unknown'][page_id % 6 + 1] END AS verdict FROM pages",
    "f36_narrow_projection": f"WITH {EVENTS} SELECT product_id, brand, CAST(day AS VARCHAR) AS day, special FROM ev",
    "f37_priced_options": f"""WITH {RECORDS} SELECT category, count(*) FILTER (coalesce(special_price, base_price) > 0) AS priced,
        count(*) FILTER (coalesce(special_price, base_price) > 0 AND weight_grams = 28) AS priced_ounce FROM rec GROUP BY category""",
    "j12_region_status": f"""WITH RECURSIVE {PAIRS} SELECT cluster_id, count(*) FILTER (balance >= 2000) AS alive, bool_and(balance < 2000) AS all_stale FROM member JOIN place USING (dispensary_id) GROUP BY cluster_id""",
    "j14_no_drop_lost": """WITH c AS (SELECT DISTINCT 's' || l_suppkey AS dispensary_id FROM lineitem),
        d AS (SELECT DISTINCT 's' || l_suppkey AS dispensary_id FROM lineitem WHERE l_discount >= 0.05::DOUBLE)
        SELECT dispensary_id, 'deals' AS source FROM c UNION ALL SELECT dispensary_id, 'drops' FROM d WHERE dispensary_id NOT IN (SELECT dispensary_id FROM c)""",
    "m12_uniform": """WITH a AS (SELECT p_partkey, (p_partkey + 1831565813) % 4294967296 AS a FROM part),
        b AS (SELECT p_partkey, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) AS t FROM a),
        c AS (SELECT p_partkey, xor((t + CAST((CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296 AS BIGINT)) % 4294967296, t) AS t FROM b)
        SELECT p_partkey, floor(xor(t, t >> 14) / 4294967296 * 10000 + 0.5::DOUBLE) / 10000 AS u FROM c""",
    "m9_drop_labels": f"""WITH {GATED} SELECT match_key, weight_grams, CASE WHEN spread_pct >= 0.1::DOUBLE THEN format('{{:.1f}}', 1 + spread_pct) || '×' ELSE CAST(CAST(floor(spread_pct * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '%' END AS phrase,
        '$' || format('{{:.2f}}', low_price) AS price FROM gap""",
    "o3_category_page": f"""WITH {GATED}, r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY spread DESC, match_key, weight_grams) AS place, match_key, weight_grams, spread,
        count(*) OVER (PARTITION BY category) AS total FROM gap) SELECT * FROM r WHERE place <= 100""",
    "o4_region_category": f"""WITH RECURSIVE {FLOORS}, r AS (SELECT cluster_id, category, row_number() OVER (PARTITION BY cluster_id, category ORDER BY floor_price, match_key, weight_grams) AS place,
        match_key, weight_grams, floor_price FROM floors) SELECT * FROM r WHERE place <= 3""",
    "o6_cheapest_stores": f"""WITH {GATED} SELECT dispensary_id, count(*) AS times_cheapest FROM flat WHERE high_price > low_price AND price = low_price GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "o12_top_category": f"WITH {GATED} SELECT category, floor(avg(spread_pct) * 100 + 0.5::DOUBLE) / 100 AS avg_spread_pct FROM gap GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "a12_widest_gap": f"""WITH {GATED}, r AS (SELECT category, match_key, weight_grams, spread_pct, row_number() OVER (PARTITION BY category ORDER BY spread_pct DESC, match_key, weight_grams) AS n FROM gap)
        SELECT category, match_key, weight_grams, spread_pct FROM r WHERE n = 1""",
    "a17_precision": f"""WITH {CITES} SELECT question, count(*) AS fired, count(*) FILTER (cited) AS acted, CAST(floor(count(*) FILTER (cited) / count(*) * 100 + 0.5::DOUBLE) AS BIGINT) AS "precision" FROM chk GROUP BY 1""",
    "s1_pack_counts": "SELECT 'p' || p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 > 0 THEN CAST(p_partkey % 7 AS INT) END AS pack_count FROM part",
    "s5_stripped_names": "SELECT p_partkey, '707 ' || p_name AS name FROM part",
    "s22_escaped_titles": r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS title FROM pages""",
    "s23_topics": f"""WITH {CATALOG} SELECT product_id, CASE partkey % 7 WHEN 0 THEN category = 'Flower' WHEN 1 THEN category = 'Vaporizers' WHEN 2 THEN category = 'Edible' WHEN 3 THEN FALSE WHEN 4 THEN TRUE
        WHEN 5 THEN category = 'Concentrate' ELSE FALSE END AS fits FROM cat""",
    "s24_places": "SELECT p_partkey, ['statewide', 'outside', 'region', 'statewide', 'uncovered', 'uncovered', 'outside', 'statewide'][p_partkey % 8 + 1] AS kind FROM part",
    "s30_channels": """SELECT p_partkey, ['Reddit reply (r/abc_1)', 'Reddit reply', 'Local-news tip / comment', 'Local-news tip / comment', 'Community/forum reply', 'IN-channel reply', 'IN-channel reply'][p_partkey % 7 + 1] AS channel FROM part""",
    "s34_store_lists": f"""WITH {CATALOG} SELECT category, CASE category WHEN 'Pre-Rolls' THEN 'Pre Rolls' ELSE category END || CASE WHEN count(*) FILTER (form <> '') > 0 THEN ' and Live Resin' ELSE '' END AS listed FROM cat GROUP BY category""",
    "s37_links": "SELECT 's' || s_suppkey AS dispensary_id, '/store/' || trim(regexp_replace(lower(s_name || ' s' || s_suppkey), '[^a-z0-9]+', '-', 'g'), '-') AS path FROM supplier",
    "dt3_windows": f"""WITH {DEALS} SELECT DISTINCT [NULL, '09:00', '16:00', '22:00', '08:00', '25:00'][w + 1] AS start_time, [NULL, '11:30', '18:00', '02:00', '08:00', '10:00'][w + 1] AS end_time,
        ['Active today', '9:00 AM – 11:30 AM', '4:00 PM – 6:00 PM', '10:00 PM – 2:00 AM', '8:00 AM – 8:00 AM', NULL][w + 1] AS window_text, [NULL, '18:30', '1:00', '9:00', '15:00', '17:00'][w + 1] AS countdown FROM deal""",
    "dt5_as_of": """WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS t FROM events),
        d AS (SELECT *, strftime(t - INTERVAL 8 HOUR, '%B %-d, %Y') AS day, epoch(TIMESTAMP '2024-01-30 12:00:00' - t) / 86400 AS age FROM e)
        SELECT event_id, CASE WHEN event_id % 3 = 0 AND t IS NOT NULL THEN ' Prices last observed as of ' || day || '; freshness currently unverified.'
            WHEN event_id % 3 = 0 THEN ' Freshness of these prices is currently unverified.' WHEN t IS NOT NULL THEN ' Prices observed as of ' || day || '.' ELSE '' END AS sentence,
          CASE WHEN t IS NULL THEN '' WHEN age <= 2 THEN 'fresh' ELSE 'stale' END AS fact, t IS NULL OR age > 14 AS artifact_stale FROM d""",
    "src1_full_history": f"""WITH {RECORDS} SELECT dispensary_id, product_id, name, category, row_number() OVER (PARTITION BY dispensary_id, partkey ORDER BY seq) AS position,
        seq AS obs_seq, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, base_price, special_price, quantity AS quantity_available FROM obs JOIN cat USING (partkey)""",
    "src7_api_data": f"""WITH {DEALS}, {PLACES}, a AS (SELECT dispensary_id, count(*) AS n FROM deal WHERE {USABLE} AND {ACTIVE} GROUP BY 1)
        SELECT dispensary_id, coalesce(n, 0) AS active_deals FROM place LEFT JOIN a USING (dispensary_id)""",
    "src12_first_attempts": """WITH e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
        f AS (SELECT user_id, event_id, k - 50 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e WHERE k > 50) SELECT user_id, event_id, size FROM f WHERE n = 1""",
    "src39_reference": f"WITH {PLACES} SELECT dispensary_id, CASE WHEN balance > 0 AND balance < 8000 THEN balance / 1000 ELSE 4.5::DOUBLE END AS price FROM place",
    "src41_zip_places": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 1 THEN '98' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') END AS zip FROM nation",
    "src43_roster": f"WITH {PLACES} SELECT dispensary_id FROM place WHERE balance > 0 UNION SELECT 's' || l_suppkey FROM lineitem WHERE l_discount >= 0.05::DOUBLE",
    "src44_log": """SELECT count(*) FILTER (event_id % 10 <> 1) AS lines, count(*) FILTER (event_id % 10 = 0) AS malformed, count(*) FILTER (event_id % 10 = 2) AS incomplete FROM events""",
    "src55_tally": "SELECT count(*) FILTER (event_id % 10 <> 1) AS fired, count(*) FILTER (event_id % 10 > 1 AND value > 20) AS acted FROM events",
    "snk8_retired_merge": """SELECT 's' || s_suppkey AS dispensary_id, CASE WHEN s_suppkey % 3 > 0 THEN '2024-01-30' ELSE '2024-01-01' END AS last_fetched_at, s_suppkey % 3 = 0 AS stale FROM supplier""",
    "snk15_upsert": """WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS a, count(*) FILTER (value > 20) AS b FROM events GROUP BY 1)
        SELECT date, CASE WHEN date < '2024-01-15' THEN 'old' ELSE 'new' END AS origin, CASE WHEN date < '2024-01-15' THEN a ELSE b END AS n FROM e""",
    "t1_feed_cards": f"""WITH {DEALS}, {PLACES}, l AS (SELECT DISTINCT dispensary_id FROM deal WHERE {USABLE} AND {ACTIVE})
        SELECT dispensary_id, CASE WHEN dispensary_id IN (SELECT dispensary_id FROM l) THEN 'live' WHEN dispensary_id IN (SELECT dispensary_id FROM deal) THEN 'expired' ELSE 'drops' END AS card FROM place""",
    "w7_store_runs": f"WITH {EVENTS} SELECT dispensary_id, count(DISTINCT day) AS runs, CAST(min(day) AS VARCHAR) AS first_run, CAST(max(day) AS VARCHAR) AS last_run FROM ev GROUP BY 1",
    "x6_unexpired": "SELECT event_id FROM events WHERE event_id % 7 = 0 OR ts >= TIMESTAMP '2024-01-15 00:00:00'",
    "x10_summary_lines": f"WITH {SHARE} SELECT run, run || ': ' || cited_questions || ' of ' || questions || ' questions cited, ' || errors || ' checks failed' AS line FROM shares",
    "f2_nested_active": f"""WITH {DEALS}, {PLACES}, a AS (SELECT dispensary_id, count(*) AS n, min(deal_id) AS f FROM deal WHERE {USABLE} AND {ACTIVE} GROUP BY 1)
        SELECT dispensary_id, CAST(coalesce(n, 0) AS INT) AS deals, f AS first_deal FROM place LEFT JOIN a USING (dispensary_id)""",
    "f8_normalized_stores": f"""WITH {PLACES} SELECT dispensary_id, CASE WHEN balance < 5000 THEN balance END AS distance_miles, CASE WHEN balance < 7000 THEN floor(lat * 10000 + 0.5::DOUBLE) / 10000 END AS lat,
        CASE WHEN balance < 7000 THEN floor(lng * 10000 + 0.5::DOUBLE) / 10000 END AS lng FROM place WHERE balance >= 0""",
    "f19_valid_drops": f"WITH {MEDIANS} SELECT dispensary_id, product_id, pct_vs_median FROM moved WHERE pct_vs_median < 0",
    "s32_citation_hits": f"""SELECT page_id AS answer_id, regexp_matches({HOST}, '(^|\\.)example\\.org$') AS cited, page_id % 2 = 0 AND NOT regexp_matches({HOST}, '(^|\\.)example\\.org$') AS named_only,
        CAST(2 AS INT) AS hosts FROM pages""",
    "s33_badges": f"""WITH {DEALS}, b AS (SELECT dispensary_id, CASE WHEN type = 'happy_hour' AND w IN (1, 2, 3, 4) THEN deal_id END AS d, w FROM deal)
        SELECT dispensary_id, CASE WHEN count(d) = 0 THEN 'Active today' ELSE [NULL, '18:30', '1:00', '9:00', '15:00', NULL][any_value(w) + 1] END AS badge FROM b GROUP BY dispensary_id""",
    "js2_classifications": """WITH c AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 5 <> 0 AS ok FROM events)
        SELECT event_id, CASE WHEN ok AND k % 9 BETWEEN 1 AND 6 THEN CAST(k % 9 AS INT) ELSE 0 END AS intent, CASE WHEN ok THEN floor(least(k / 50, 1) * 10000 + 0.5::DOUBLE) / 10000 ELSE 0 END AS confidence FROM c""",
    "src50_listed_values": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_size = 7 THEN CAST(p_size AS VARCHAR) ELSE p_size || ',7' END AS listed FROM part",
    "x2_headlines": f"""WITH {GATED} SELECT match_key, weight_grams, display_name || CASE WHEN stores > 2 THEN ': $' || format('{{:.2f}}', low_price) || ' to $' || format('{{:.2f}}', high_price) || ' across ' || stores || ' stores'
        ELSE ': from $' || format('{{:.2f}}', low_price) || ' nearby' END AS headline FROM gap""",
    "r3_region_caveats": "WITH s AS (" + FIRST["d13_standing_floors"] + ") SELECT cluster_id, category, count(*) AS floors, bool_and(stale) AS caveat FROM s GROUP BY ALL",
    "r7_site_entries": "WITH s AS (" + FIRST["t5_sitemap"] + ") SELECT path, '<url><loc>https://site.example/?a=1&amp;b=' || path || '</loc></url>' AS entry FROM s",
}
