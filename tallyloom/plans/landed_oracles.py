"""SQL that gives the rows of the queries over landed payloads, written for DuckDB from the tables that the payloads are made of."""

from __future__ import annotations

from .oracles import CATALOG, HOST

ORACLES = {
    "src8_product_pages": f"""WITH {CATALOG}, p AS (SELECT *, p_partkey // 50 AS page, 'p' || p_partkey % 150 AS product_id FROM part JOIN (SELECT partkey, category FROM cat) ON partkey = p_partkey),
        f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY p_partkey) AS n FROM p WHERE page % 7 NOT IN (3, 5))
        SELECT product_id, p_name AS name, category, p_brand AS brand, p_partkey % 2 = 0 AS special, p_size || 'g' AS option, p_retailprice AS base_price,
          CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 2 END AS special_price, NULL::DOUBLE AS other_price, CASE WHEN p_partkey % 5 > 0 THEN 18::DOUBLE END AS thc_low,
          CASE WHEN p_partkey % 5 > 0 THEN 20::DOUBLE + p_partkey % 3 END AS thc_high FROM f WHERE n = 1 AND category IN ('Flower', 'Edible')""",
    "src12_menu_items": """WITH p AS (SELECT *, replace(p_name, ' ', '-') || '-cart-' || p_partkey % 150 AS product_id FROM part),
        f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY p_partkey) AS n FROM p)
        SELECT product_id, p_name AS name, 'Vaporizers' AS category, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS brand,
          p_retailprice AS base_price, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 2 END AS special_price, p_partkey % 2 = 0 AS special FROM f WHERE n = 1 AND p_partkey % 3 > 0""",
    "src21_card_deals": """WITH p AS (SELECT *, p_partkey // 50 AS page_id, CAST(row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS INT) AS pos, p_partkey % 3 = 0 AS happy FROM part)
        SELECT page_id, pos, CASE WHEN happy THEN 'happy_hour' ELSE 'daily' END AS type, p_name || CASE WHEN happy THEN ' 7-8am ' || (p_size + 1) || '% OFF' ELSE ' ' || (p_size + 1) || '% off & more, tuesday' END AS description,
          CAST(p_size + 1 AS INT) AS discount_pct, CASE WHEN happy THEN '07:00' END AS start_time, CASE WHEN happy THEN '08:00' END AS end_time,
          CASE WHEN happy THEN 'everyday' ELSE 'tuesday' END AS days_valid FROM p WHERE p_partkey % 3 < 2""",
    "src45_feed_posts": """SELECT 'c' || conv_id || 't' || turn AS id, coalesce(role, '') AS title, md5(CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE '' END) AS text_md5, '' AS permalink
        FROM conversations WHERE turn % 4 < 2""",
    "src47_feed_entries": "SELECT 'c' || conv_id || 't' || turn AS id, 'Turn & ' || role AS title, 'said by ' || turn AS text FROM conversations WHERE turn % 3 < 2",
    "src48_first_domains": f"SELECT DISTINCT {HOST} AS domain FROM pages",
    "snk1_fact_write": f"""WITH {CATALOG}, f AS (SELECT product_id, category FROM cat WHERE category = 'Flower'), k AS (SELECT count(*) AS n FROM f)
        SELECT product_id, category, '2026-01-02' AS generated_at, n AS fact_count, '{{"total":' || n || '}}' AS counters FROM f, k""",
}
