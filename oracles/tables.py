"""Common table expressions shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

PRODUCTS = """
offers AS (
  SELECT l_suppkey, l_partkey, count(*) AS nb,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
    max(l_linestatus) AS ls, max(l_shipdate) AS d
  FROM lineitem GROUP BY l_suppkey, l_partkey),
per_part AS (
  SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS ret
  FROM lineitem GROUP BY l_partkey),
base AS (
  SELECT *, CASE l_suppkey % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' ELSE 'playwright' END AS source
  FROM offers JOIN per_part USING (l_partkey)
  JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
products AS (
  SELECT source, s_name AS shop_url, CAST(p_partkey AS VARCHAR) AS product_id, p_partkey AS pk,
    source || '_' || s_name || '_' || p_partkey AS uid, p_name AS nom,
    CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN p_name
      ELSE p_name || ' - ' || p_brand || ' - ' || p_type || ' - ' || s_name END AS description,
    lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS categorie, p_brand AS marque,
    lower(p_type) || ', ' || lower(p_brand) AS tags,
    CAST(cents AS DOUBLE) / 100 / qty / (1 + p_partkey % 40) AS prix,
    CASE WHEN disc > 5 * nb THEN CAST(disc AS DOUBLE) * 4 / nb ELSE 0.0::DOUBLE END AS remise_pct,
    5.0::DOUBLE - 2.0::DOUBLE * ret / n AS rating, n * 30 AS nb_reviews, ls = 'O' AS disponible,
    qty AS stock, CAST(p_size % 7 AS INTEGER) AS nb_images, nb AS nb_variants,
    strftime(d, '%Y-%m-%d') AS date_creation
  FROM base)"""

FEATURES = PRODUCTS + """,
derived AS (
  SELECT *, CASE WHEN prix > 0 THEN rating / ln(1 + prix) ELSE 0 END AS ratio_qualite_prix,
    rating * 0.4 + ln(1 + nb_reviews) * 0.4 + CAST(disponible AS INTEGER) * 0.2 AS score_popularite,
    CASE WHEN remise_pct > 0 THEN 1 ELSE 0 END AS en_promo,
    CASE WHEN prix <= 0 THEN NULL WHEN prix <= 20 THEN 'très_bas' WHEN prix <= 50 THEN 'bas'
      WHEN prix <= 100 THEN 'moyen' WHEN prix <= 200 THEN 'élevé' ELSE 'premium' END AS segment_prix
  FROM products)"""

SCORED = FEATURES + """,
bounds AS (
  SELECT min(rating) AS lr, max(rating) AS hr, min(ln(1 + nb_reviews)) AS lv, max(ln(1 + nb_reviews)) AS hv,
    min(ratio_qualite_prix) AS lq, max(ratio_qualite_prix) AS hq,
    min(greatest(prix, 0)) AS lp, max(greatest(prix, 0)) AS hp,
    max(remise_pct) AS hd, max(stock) AS hs FROM derived),
targeted AS (
  SELECT derived.*, (1 - (greatest(prix, 0) - lp) / (hp - lp + 1e-9)) * 40
      + remise_pct / (hd + 1e-9) * 25 + CAST(disponible AS DOUBLE) * 20
      + CAST(stock AS DOUBLE) / (hs + 1e-9) * 15 AS target_score,
    round((rating - lr) / (hr - lr) * 30 + (ln(1 + nb_reviews) - lv) / (hv - lv) * 25
      + (ratio_qualite_prix - lq) / (hq - lq) * 15 + CAST(disponible AS DOUBLE) * 5, 2) AS score_composite
  FROM derived, bounds),
cut AS (SELECT quantile_cont(target_score, 0.7) AS q FROM targeted),
enriched AS (
  SELECT targeted.*, CASE WHEN target_score >= q THEN 1 ELSE 0 END AS top_produit,
    rank() OVER (ORDER BY score_composite DESC) AS rang,
    CASE WHEN score_composite < 0 THEN 'nan' WHEN score_composite <= 30 THEN 'Entrée gamme'
      WHEN score_composite <= 50 THEN 'Standard' WHEN score_composite <= 70 THEN 'Bestseller'
      WHEN score_composite <= 100 THEN 'Premium' ELSE 'nan' END AS segment
  FROM targeted, cut)"""

DIRTY = PRODUCTS + """,
once AS (
  SELECT source, shop_url, product_id, pk,
    CASE WHEN pk % 37 = 0 THEN NULL WHEN pk % 31 = 0 THEN 'x'
      ELSE '  ' || replace(nom, ' ', '  l''eau-') || ' ' END AS nom,
    CASE WHEN pk % 19 <> 0 THEN ' ' || upper(categorie) END AS categorie,
    CASE WHEN pk % 23 = 0 THEN 'n/a' WHEN pk % 29 = 0 THEN '-5'
      ELSE CAST(CAST(floor(prix) AS BIGINT) AS VARCHAR) || '.50' END AS prix,
    CASE WHEN pk % 3 = 0 THEN '12.5' END AS remise_pct,
    CASE WHEN pk % 17 <> 0 THEN CAST(round(rating, 1) AS VARCHAR) END AS rating,
    CAST(nb_reviews AS VARCHAR) || '.7' AS nb_reviews,
    CASE WHEN pk % 41 <> 0 THEN CAST(stock AS VARCHAR) ELSE 'many' END AS stock,
    ['TRUE', '1', 'Oui', 'no'][pk % 4 + 1] AS disponible, 0 AS seq
  FROM products),
dirty AS (
  SELECT * FROM once UNION ALL SELECT * REPLACE ('1.50' AS prix, 1 AS seq) FROM once WHERE pk % 11 = 0),
cleaned AS (
  SELECT source, shop_url, product_id, pk, seq,
    regexp_replace(array_to_string(list_transform(regexp_extract_all(trim(nom), '[a-zA-Z]+|[^a-zA-Z]+'),
      lambda x: upper(x[1]) || lower(x[2:])), ''), '\\s+', ' ', 'g') AS nom,
    trim(lower(coalesce(categorie, 'inconnu'))) AS categorie,
    coalesce(TRY_CAST(prix AS DOUBLE), 0) AS prix, coalesce(TRY_CAST(remise_pct AS DOUBLE), 0) AS remise_pct,
    coalesce(TRY_CAST(rating AS DOUBLE), 0) AS rating,
    CAST(trunc(coalesce(TRY_CAST(nb_reviews AS DOUBLE), 0)) AS BIGINT) AS nb_reviews,
    CAST(trunc(coalesce(TRY_CAST(stock AS DOUBLE), 0)) AS BIGINT) AS stock,
    coalesce(lower(disponible) IN ('true', '1', 'yes', 'oui'), false) AS disponible
  FROM dirty)"""

SHOP = PRODUCTS + """,
shop0 AS (
  SELECT *, pk % 13 = 0 AS bare,
    CAST((pk % 500 + 1) || '.' || lpad(CAST(pk % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS p0,
    CASE WHEN pk % 5 < 2 THEN 0.0 WHEN pk % 5 = 2 THEN pk % 400 + 1.0 ELSE pk % 500 + 40.5 END::DOUBLE AS c0
  FROM products WHERE source = 'shopify'),
shop AS (
  SELECT * REPLACE (CASE WHEN bare THEN 0 ELSE p0 END AS prix, NOT bare AND disponible AS disponible,
      CASE WHEN bare THEN 0 ELSE stock END AS stock, nb_images + 1 AS nb_images,
      CASE WHEN bare THEN 0 ELSE 2 END AS nb_variants, nom || ' ' || marque || '  & é' AS description,
      CASE WHEN pk % 11 = 0 THEN '' ELSE marque || ', promo' END AS tags),
    CASE WHEN bare THEN 0 ELSE c0 END AS prix_compare
  FROM shop0)"""

STORE = PRODUCTS + """,
store0 AS (
  SELECT *, (pk % 300 + 20)::DOUBLE AS reg,
    CASE pk % 4 WHEN 0 THEN 0 WHEN 1 THEN pk % 300 + 30 ELSE pk % 300 + 5.25 END::DOUBLE AS sale
  FROM products WHERE source = 'woocommerce'),
store AS (
  SELECT source, shop_url, product_id, nom, nom AS description, marque AS description_courte,
    categorie || ', ' || marque AS categorie, CASE WHEN pk % 6 = 0 THEN '' ELSE 'promo' END AS tags,
    CASE WHEN pk % 4 < 2 THEN reg ELSE sale END AS prix, reg AS prix_regular, sale AS prix_promo,
    CASE WHEN sale > 0 AND sale < reg THEN round((1 - sale / reg) * 100, 1) ELSE 0 END AS remise_pct,
    CAST((pk % 4 + 1) || '.' || (pk % 10) AS DOUBLE) AS rating,
    CASE WHEN pk % 9 = 0 THEN 0 ELSE nb_reviews END AS nb_reviews, disponible,
    CASE WHEN pk % 8 = 0 THEN 0 ELSE stock END AS stock, pk % 1000 AS nb_ventes,
    (pk % 7) || '.5' AS poids, date_creation, 1 AS nb_images
  FROM store0)"""

CARDS = PRODUCTS + """,
card0 AS (
  SELECT 'https://www.' || lower(regexp_replace(shop_url, '[^A-Za-z0-9]', '', 'g')) || '.example/'
      || ['women/shoes', 'running', 'kids-bags', 'new', 'gym/shirt'][pk % 5 + 1] AS url,
    pk AS position, CASE WHEN pk % 37 = 0 THEN 'ab' ELSE nom || ' ' || marque END AS nom,
    CASE pk % 5 WHEN 0 THEN '€ ' || (pk % 300) || ',' || lpad(CAST(pk % 100 AS VARCHAR), 2, '0')
      WHEN 1 THEN (pk % 200) || '.' || lpad(CAST(pk % 100 AS VARCHAR), 2, '0') || ' EUR'
      WHEN 2 THEN '1.' || lpad(CAST(pk % 1000 AS VARCHAR), 3, '0') || ',50 €'
      WHEN 3 THEN 'n/a' ELSE '$' || (pk % 90) END AS prix_raw,
    CASE pk % 5 WHEN 0 THEN pk % 300 + (pk % 100) / 100 WHEN 1 THEN pk % 200 + (pk % 100) / 100
      WHEN 2 THEN 1000 + pk % 1000 + 0.5 WHEN 3 THEN 0 ELSE pk % 90 END AS amount,
    CASE WHEN pk % 3 <> 0 THEN 'img.jpg' ELSE '' END AS image, '/p/' || pk AS url_produit
  FROM products WHERE source = 'playwright'),
card AS (
  SELECT *, CASE WHEN contains(url, 'women/shoes') THEN 'Chaussures' WHEN contains(url, 'running') THEN 'Running'
      WHEN contains(url, 'kids-bags') THEN 'Enfants' WHEN contains(url, 'gym/shirt') THEN 'Hauts'
      ELSE 'Mode' END AS categorie,
    round(amount, 2) AS prix FROM card0 WHERE length(trim(nom)) > 2),
card1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, left(lower(nom), 50) ORDER BY position) AS rn FROM card)
  WHERE rn = 1)"""

ORDERS = """
bought AS (
  SELECT DISTINCT l_orderkey AS basket, lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS item
  FROM lineitem JOIN part ON p_partkey = l_partkey),
pairs AS (
  SELECT * FROM bought WHERE basket IN (SELECT basket FROM bought GROUP BY 1 HAVING count(*) >= 2))"""


def counted(limit: int) -> str:
    """Item and pair counts of the baskets left by a vocabulary limit."""
    return ORDERS + f""",
words AS (SELECT item FROM pairs GROUP BY item ORDER BY count(*) DESC, item LIMIT {limit}),
few AS (SELECT * FROM pairs WHERE item IN (SELECT item FROM words)),
kept AS (SELECT * FROM few WHERE basket IN (SELECT basket FROM few GROUP BY 1 HAVING count(*) >= 2)),
total AS (SELECT count(DISTINCT basket) AS baskets FROM kept),
counts AS (
  SELECT item AS a, NULL AS b, count(*) AS n FROM kept GROUP BY item
  UNION ALL
  SELECT x.item, y.item, count(*) FROM kept x JOIN kept y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2),
sets AS (SELECT a, b, n, baskets, n / baskets AS support FROM counts, total)"""


AUDIT = """
log AS (
  SELECT event_id, ts AS timestamp, 'server-' || (user_id % 4) AS server_id, event_type AS tool_name,
    'call ' || event_type AS action,
    CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN 'DENIED' WHEN 'view' THEN 'WARNING'
      ELSE 'SUCCESS' END AS status,
    value AS duration_ms, props AS details, CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error,
    CASE WHEN event_type = 'purchase' THEN 'write_data' ELSE 'read_data' END AS permission
  FROM events),
entries AS (
  SELECT event_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, server_id, tool_name, action, status,
    CASE WHEN event_id % 10 = 3 THEN 0 ELSE round(duration_ms + 0.001, 2) END AS duration_ms,
    CASE WHEN event_id % 10 = 5 THEN '{}' ELSE details END AS details,
    CASE WHEN event_id % 10 = 7 THEN '' ELSE error END AS error
  FROM log),
checked AS (
  SELECT event_id, server_id, permission, action,
    CASE WHEN server_id = 'server-3' THEN 'Serveur non enregistré'
      WHEN server_id = 'server-2' THEN 'Serveur non approuvé'
      WHEN server_id = 'server-1' AND permission <> 'read_data'
        THEN 'Permission ''' || permission || ''' non déclarée dans le manifeste' END AS reason
  FROM log)"""
