"""One SQL statement per registered query that plain SQL can express."""

from __future__ import annotations

from oracles.tables import (
    AUDIT, CARDS, DIRTY, FEATURES, ORDERS, PRODUCTS, SCORED, SHOP, STORE, counted,
)

STATEMENTS: dict[str, str] = {}


def add(name: str, tables: str, select: str) -> None:
    STATEMENTS[name] = (f"WITH {tables.strip()}\n{select}" if tables else select).strip()


# ---- sources and sinks

add("s0_products", PRODUCTS, """
SELECT shop_url, product_id, uid, nom, description, categorie, marque, tags, prix,
  remise_pct, rating, nb_reviews, disponible, stock, nb_images,
  nb_variants, source FROM products""")
add("s1_csv_read", PRODUCTS, """
SELECT uid, nom, nom || ' ' || chr(10) || ' "' || marque || '", x' AS description, prix,
  disponible, stock FROM products""")
add("s2_shop_pages", PRODUCTS, """
SELECT shop_url, pk AS id, '  ' || nom || ' ' AS title, categorie AS product_type, marque AS vendor
FROM products WHERE source = 'shopify'""")
add("s3_store_pages", PRODUCTS, """
SELECT shop_url, pk AS id, nom || ' ' AS name, (pk % 300 + 20) || '.00' AS regular_price,
  (pk % 4 + 1) || '.' || (pk % 10) AS average_rating FROM products WHERE source = 'woocommerce'""")
add("s4_cards", CARDS, "SELECT url, position, nom, prix_raw, image FROM card")
add("s5_audit_read", AUDIT, """
SELECT timestamp, server_id, tool_name, status, duration_ms, error FROM entries""")
add("s6_audit_append", AUDIT, """
SELECT timestamp, server_id, tool_name, action, status, duration_ms, details, error
FROM entries""")
add("s7_csv_sink", SCORED, "SELECT uid, nom, rang, score_composite FROM enriched")
add("s8_saved_table", PRODUCTS, "SELECT uid, nom, stock, disponible FROM products")
add("s9_first_existing", PRODUCTS, "SELECT source, count(*) AS n FROM products GROUP BY source")

# ---- ingest

add("n1_shop_flatten", SHOP, """
SELECT source, shop_url, product_id, nom, description, categorie, marque, prix, prix_compare, disponible, stock,
  nb_images, nb_variants FROM shop""")
add("n2_tags", SHOP, "SELECT shop_url, product_id, tags FROM shop")
add("n3_discount", SHOP, """
SELECT shop_url, product_id, prix, prix_compare,
  CASE WHEN prix > 0 AND prix_compare > 0 THEN round((1 - prix / prix_compare) * 100, 1) ELSE 0 END AS remise_pct
FROM shop""")
add("n4_discount_guarded", SHOP, """
SELECT shop_url, product_id,
  CASE WHEN prix > 0 AND prix_compare > prix THEN round((1 - prix / prix_compare) * 100, 1) ELSE 0 END AS remise_pct
FROM shop""")

_PLAIN = """
stripped AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', chr(1), 'g'),
      '(?s)<!--.*?-->', chr(1), 'g'), '<[!/?a-zA-Z][^>]*>', chr(1), 'g') AS t FROM pages),
plain AS (
  SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(t, chr(1) || '+', ' ', 'g'),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g') AS text FROM stripped)"""
add("n5_html_text", _PLAIN, "SELECT page_id, substr(text, 1, 500) AS description FROM plain")
add("n5_html_text_whole", _PLAIN, "SELECT page_id, length(text) AS n_chars, md5(text) AS digest FROM plain")
add("n6_store_flatten", STORE, "SELECT * EXCLUDE (categorie, tags, remise_pct) FROM store")
add("n7_store_names", STORE, "SELECT shop_url, product_id, categorie, tags FROM store")
add("n8_store_discount", STORE, "SELECT shop_url, product_id, prix_regular, prix_promo, remise_pct FROM store")
add("n9_card_price", CARDS, "SELECT url AS shop_url, position, CAST(prix AS DOUBLE) AS prix FROM card")
add("n10_stable_id", "", "SELECT page_id, left(md5(url || '_' || page_id), 12) AS id FROM pages")

_KEYWORDS = (
    ("shoe", "Chaussures"), ("sneaker", "Chaussures"), ("running", "Running"), ("men", "Homme"),
    ("women", "Femme"), ("kids", "Enfants"), ("jacket", "Vestes"), ("shirt", "Hauts"), ("pant", "Bas"),
    ("sport", "Sport"), ("fitness", "Fitness"), ("gym", "Gym"), ("dress", "Robes"), ("bag", "Sacs"),
    ("watch", "Montres"),
)
_CHOICE = " ".join(f"WHEN contains(lower(shop_url), '{k}') THEN '{v}'" for k, v in _KEYWORDS)
add("n11_url_category", CARDS + """,
urls AS (SELECT url AS shop_url FROM card UNION SELECT url FROM pages)""",
    f"SELECT shop_url, CASE {_CHOICE} ELSE 'Mode' END AS categorie FROM urls")
add("n12_url_brand", """
hosts AS (
  SELECT page_id, split_part(split_part(regexp_replace(url, 'https?://(www\\.)?', ''), '/', 1), '.', 1) AS h FROM pages)""",
    "SELECT page_id, upper(h[1]) || lower(h[2:]) AS marque FROM hosts")
add("n13_card_rows", CARDS, """
SELECT 'playwright' AS source, url AS shop_url, left(md5(url || '_' || nom), 12) AS product_id, nom, categorie,
  upper(split_part(split_part(url, 'www.', 2), '.', 1)[1]) || split_part(split_part(url, 'www.', 2), '.', 1)[2:] AS marque,
  CAST(prix AS DOUBLE) AS prix, 0.0::DOUBLE AS prix_compare, 0.0::DOUBLE AS remise_pct, true AS disponible,
  0 AS stock, 0.0::DOUBLE AS rating, 0 AS nb_reviews, CASE WHEN image <> '' THEN 1 ELSE 0 END AS nb_images,
  1 AS nb_variants, url_produit, image, position FROM card""")
add("n14_card_dedupe", CARDS, "SELECT url AS shop_url, nom, position, CAST(prix AS DOUBLE) AS prix FROM card1")

_CARD_TAIL = CARDS[len(PRODUCTS):]
_STORE_TAIL = STORE[len(PRODUCTS):]
_ALL = SHOP + _STORE_TAIL + _CARD_TAIL
add("n15_union", _ALL, """
SELECT 'shopify' AS source, count(*) AS n, 0 AS n_rating, count(*) AS n_variants, 0 AS n_regular, count(*) AS n_compare FROM shop
UNION ALL SELECT 'woocommerce', count(*), count(*), 0, count(*), 0 FROM store
UNION ALL SELECT 'playwright', count(*), count(*), count(*), 0, count(*) FROM card1""")
add("n16_required", PRODUCTS, """
SELECT count(*) AS n, count(*) AS n_source, count(*) AS n_shop_url, count(*) AS n_product_id, count(*) AS n_nom,
  0 AS n_description, 0 AS n_categorie, 0 AS n_prix, 0 AS n_remise_pct, 0 AS n_rating, 0 AS n_nb_reviews,
  0 AS n_disponible, 0 AS n_stock, 0 AS n_date_creation FROM products""")
add("n17_names", DIRTY, "SELECT shop_url, product_id, seq, nom FROM cleaned")
add("n18_n20_clean", DIRTY, """
SELECT shop_url, product_id, seq, categorie, prix, remise_pct, rating, nb_reviews, stock, disponible FROM cleaned""")
add("n21_dedupe", DIRTY, "SELECT shop_url, product_id, seq, prix FROM dirty WHERE seq = 0")
add("n23_normalised", DIRTY, """
SELECT source || '_' || product_id AS uid, source, shop_url, product_id, nom, categorie, prix, remise_pct, rating,
  nb_reviews, disponible, stock
FROM (SELECT *, row_number() OVER (PARTITION BY shop_url, product_id ORDER BY seq) AS rn FROM cleaned)
WHERE rn = 1 AND length(nom) > 2 AND prix >= 0""")
add("n23_source_summary", _ALL, """
SELECT 'shopify' AS source, count(*) AS n FROM shop WHERE length(nom) > 2
UNION ALL SELECT 'woocommerce', count(*) FROM store WHERE length(nom) > 2
UNION ALL SELECT 'playwright', count(*) FROM card1""")

# ---- features

_RD = "round(ratio_qualite_prix, 6) AS ratio_qualite_prix, round(score_popularite, 6) AS score_popularite"
add("f1_f4_derived", FEATURES, f"SELECT uid, {_RD}, en_promo, segment_prix FROM derived")
add("f4_band_counts", FEATURES, """
SELECT segment_prix, count(*) AS n, CASE segment_prix WHEN 'très_bas' THEN 0 WHEN 'bas' THEN 1 WHEN 'moyen' THEN 2
  WHEN 'élevé' THEN 3 WHEN 'premium' THEN 4 END AS ordre FROM derived GROUP BY segment_prix""")
add("f5_label_codes", PRODUCTS, """
SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (
  SELECT DISTINCT coalesce(CASE WHEN pk % 19 <> 0 THEN categorie END, 'inconnu') AS value FROM products)""")

_HOLED = PRODUCTS + """,
holed AS (
  SELECT * REPLACE (CASE WHEN pk % 17 <> 0 THEN rating END AS rating, CASE WHEN pk % 23 <> 0 THEN prix END AS prix,
    CASE WHEN pk % 5 <> 0 THEN stock END AS stock) FROM products),
hd AS (
  SELECT *, CASE WHEN prix > 0 THEN rating / ln(1 + prix) ELSE 0 END AS ratio_qualite_prix,
    rating * 0.4 + ln(1 + nb_reviews) * 0.4 + CAST(disponible AS INTEGER) * 0.2 AS score_popularite FROM holed),
med AS (
  SELECT quantile_cont(prix, 0.5) AS mp, quantile_cont(rating, 0.5) AS mr, quantile_cont(CAST(stock AS DOUBLE), 0.5) AS ms,
    quantile_cont(ratio_qualite_prix, 0.5) AS mq, quantile_cont(score_popularite, 0.5) AS mo FROM hd),
imp AS (
  SELECT uid, coalesce(prix, mp) AS prix, remise_pct, coalesce(rating, mr) AS rating,
    CAST(nb_reviews AS DOUBLE) AS nb_reviews, coalesce(CAST(stock AS DOUBLE), ms) AS stock,
    coalesce(ratio_qualite_prix, mq) AS ratio_qualite_prix, coalesce(score_popularite, mo) AS score_popularite
  FROM hd, med)"""
_NUM = ("prix", "rating", "nb_reviews", "stock", "remise_pct", "ratio_qualite_prix", "score_popularite")
_EXACT = ("prix", "remise_pct", "rating", "nb_reviews", "stock")


def _shown(columns: tuple) -> str:
    return ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" if c in _EXACT else f"round({c}, 6) AS {c}" for c in columns
    )


add("f6_imputed", _HOLED, f"SELECT uid, {_shown(_NUM)} FROM imp")


def _scaled(table: str, columns: tuple) -> str:
    return ", ".join(
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_norm" for c in columns
    )


add("f7_scaled", _HOLED, f"SELECT uid, {_scaled('imp', _NUM)} FROM imp")
_CODES = (
    "dense_rank() OVER (ORDER BY categorie) - 1 AS categorie_enc, "
    "dense_rank() OVER (ORDER BY source) - 1 AS source_enc"
)
add("f8_container_features", FEATURES, f"SELECT uid, {_CODES}, {_scaled('derived', _NUM[:-1])} FROM derived")
add("f9_features", FEATURES, f"""
SELECT uid, en_promo, segment_prix, {_CODES}, {_shown(_NUM)},
  {_scaled('derived', _NUM)} FROM derived""")
add("f10_coercion", DIRTY, """
SELECT shop_url, product_id, seq, coalesce(TRY_CAST(prix AS DOUBLE), 0) AS prix,
  coalesce(TRY_CAST(remise_pct AS DOUBLE), 0) AS remise_pct, coalesce(TRY_CAST(rating AS DOUBLE), 0) AS rating,
  coalesce(TRY_CAST(nb_reviews AS DOUBLE), 0) AS nb_reviews, coalesce(TRY_CAST(stock AS DOUBLE), 0) AS stock FROM dirty""")

_FALL = PRODUCTS + """,
ends AS (SELECT min(prix) AS lo, max(prix) AS hi, min(remise_pct) AS dl, max(remise_pct) AS dh FROM products),
fall AS (
  SELECT products.*, ends.*, round((1 - (prix - lo) / (hi - lo + 1e-9)) * 35 + remise_pct / (dh + 1e-9) * 30
    + rating / 5 * 25 + CAST(disponible AS DOUBLE) * 10, 2) AS score_composite FROM products, ends),
banded AS (
  SELECT *, CASE WHEN score_composite < 0 THEN 'nan' WHEN score_composite <= 30 THEN 'Entrée gamme'
      WHEN score_composite <= 50 THEN 'Standard' WHEN score_composite <= 70 THEN 'Bestseller'
      WHEN score_composite <= 100 THEN 'Premium' ELSE 'nan' END AS segment FROM fall)"""
add("f11_fallback_score", _FALL, "SELECT uid, score_composite FROM fall")
add("f12_fallback_rank_label", _FALL, """
SELECT uid, rank() OVER (ORDER BY score_composite DESC) AS rang,
  CASE WHEN score_composite >= (SELECT quantile_cont(score_composite, 0.7) FROM fall) THEN 1 ELSE 0 END AS top_produit
FROM fall""")
add("f13_score_bands", _FALL, "SELECT segment, count(*) AS n FROM banded GROUP BY segment")
add("f14_fallback_columns", _FALL, """
SELECT uid, segment, round(CASE WHEN prix > 0 THEN rating / ln(1 + prix) ELSE 0 END, 4) AS ratio_qualite_prix,
  CASE WHEN remise_pct > 0 THEN 1 ELSE 0 END AS en_promo, round((prix - lo) / (hi - lo + 1e-9), 4) AS prix_norm,
  round((remise_pct - dl) / (dh - dl + 1e-9), 4) AS remise_pct_norm FROM banded""")

# ---- clusters

_PROFILE = PRODUCTS + """,
profile AS (
  SELECT pk % 4 AS cluster_kmeans, round(avg(prix), 2) AS prix, round(avg(rating), 2) AS rating,
    round(avg(nb_reviews), 2) AS nb_reviews, round(avg(remise_pct), 2) AS remise_pct, count(*) AS n
  FROM products GROUP BY 1)"""
add("c4_cluster_profile", _PROFILE, "SELECT * EXCLUDE (n) FROM profile")
add("c5_cluster_names", _PROFILE, """
SELECT cluster_kmeans, n, CASE WHEN rating >= 4.5 AND prix > 100 THEN 'Premium populaire'
  WHEN rating >= 4 AND nb_reviews > 500 THEN 'Bestseller' WHEN remise_pct > 20 THEN 'Produit en promo'
  WHEN prix < 30 THEN 'Entrée de gamme' ELSE 'Segment ' || cluster_kmeans END AS segment FROM profile""")

_AXES = ("prix", "rating", "nb_reviews", "stock", "remise_pct", "ratio_qualite_prix")
add("c3_silhouette", FEATURES + f""",
z AS (
  SELECT pk % 4 AS c, {", ".join(f"coalesce(({a} - min({a}) OVER ()) / nullif(max({a}) OVER () - min({a}) OVER (), 0), 0) AS x{i}" for i, a in enumerate(_AXES))}
  FROM derived),
totals AS (
  SELECT c, count(*) AS n, {", ".join(f"sum(x{i}) AS s{i}, sum(x{i} * x{i}) AS q{i}" for i in range(6))} FROM z GROUP BY c),
far AS (
  SELECT {" + ".join(f"(t.n * x{i} * x{i} + q{i} - 2 * x{i} * s{i})" for i in range(6))} AS total, t.n, z.c = t.c AS own, z.rn
  FROM (SELECT *, row_number() OVER () AS rn FROM z) z, totals t),
near AS (
  SELECT rn, max(total / (n - 1)) FILTER (own) AS a, min(total / n) FILTER (NOT own) AS b FROM far GROUP BY rn)""",
    "SELECT (SELECT count(*) FROM totals) AS k, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM near")

_VECTORS = FEATURES + f""",
z AS (
  SELECT uid, pk % 4 AS c, {", ".join(f"coalesce(({a} - min({a}) OVER ()) / nullif(max({a}) OVER () - min({a}) OVER (), 0), 0)::DOUBLE AS x{i}" for i, a in enumerate(_AXES))}
  FROM derived)"""
_GAP = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(6))
add("c3_silhouette_sample", _VECTORS + f""",
s AS (SELECT * FROM z ORDER BY md5(uid), uid LIMIT 2000),
far AS (
  SELECT a.uid, a.c, b.c AS other, sum(sqrt({_GAP})) AS total, count(*) AS n FROM s a, s b GROUP BY ALL),
near AS (
  SELECT uid, max(CASE WHEN n > 1 THEN total / (n - 1) END) FILTER (c = other) AS a, min(total / n) FILTER (c <> other) AS b
  FROM far GROUP BY uid)""",
    "SELECT count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM near")
# Vectors with their weights meet in cells of side eps on three axes; the others are compared.
_CELLS = ", ".join(f"CAST(floor(x{i} / 0.15) AS BIGINT) AS k{i}" for i in (0, 1, 4))
_MOVES = "(VALUES (-1), (0), (1)) d0(m0), (VALUES (-1), (0), (1)) d1(m1), (VALUES (-1), (0), (1)) d4(m4)"
_REACH = _VECTORS + f""",
v AS (SELECT row_number() OVER () AS id, count(*) AS w, x0, x1, x2, x3, x4, x5, {_CELLS} FROM z GROUP BY ALL),
near AS MATERIALIZED (
  SELECT a.id, b.id AS other, b.w FROM (SELECT v.*, k0 + m0 AS j0, k1 + m1 AS j1, k4 + m4 AS j4 FROM v, {_MOVES}) a
  JOIN v b ON b.k0 = a.j0 AND b.k1 = a.j1 AND b.k4 = a.j4
  WHERE abs(a.x2 - b.x2) <= 0.15 AND abs(a.x3 - b.x3) <= 0.15 AND abs(a.x5 - b.x5) <= 0.15 AND {_GAP} <= 0.15::DOUBLE * 0.15::DOUBLE),
core AS (SELECT id FROM near GROUP BY id HAVING sum(w) >= 5),
reached AS (SELECT DISTINCT near.id FROM near JOIN core ON near.other = core.id)"""
add("c6_outliers", _REACH, """
SELECT z.uid, CASE WHEN reached.id IS NULL THEN 1 ELSE 0 END AS is_anomalie
FROM z JOIN v USING (x0, x1, x2, x3, x4, x5) LEFT JOIN reached ON reached.id = v.id""")

# Every core vector takes the smallest number that reaches it, until none changes: one number a cluster.
add("c7_outlier_counts", "RECURSIVE " + _REACH.strip() + """,
links AS MATERIALIZED (SELECT near.id, near.other FROM near JOIN core a ON a.id = near.id JOIN core b ON b.id = near.other),
least(id, root) USING KEY (id) AS (
  SELECT id, id AS root FROM core
  UNION
  SELECT links.id, min(least.root) FROM least JOIN links ON links.other = least.id JOIN recurring.least AS known ON known.id = links.id
  WHERE least.root < known.root GROUP BY links.id)""", """
SELECT (SELECT count(DISTINCT root) FROM least) AS n_clusters,
  (SELECT count(*) FROM z JOIN v USING (x0, x1, x2, x3, x4, x5) LEFT JOIN reached ON reached.id = v.id WHERE reached.id IS NULL) AS n_outliers""")

# ---- label, evaluation

add("l1_target", SCORED, "SELECT uid, top_produit FROM enriched")
add("l2_flat_guard", PRODUCTS, """
SELECT count(*) AS n, count(*) - CAST(ceil(0.7 * (count(*) - 1)) AS BIGINT) AS top_n FROM products""")
add("l3_container_target", PRODUCTS + """,
ends AS (SELECT min(prix) AS lo, max(prix) AS hi, max(remise_pct - 1) AS dh, max(stock) AS hs FROM products),
t AS (
  SELECT uid, (1 - (prix - lo) / (hi - lo + 1e-9)) * 40 + (remise_pct - 1) / (dh + 1e-9) * 30
    + CAST(stock AS DOUBLE) / (hs + 1e-9) * 30 AS s FROM products, ends)""", """
SELECT uid, CASE WHEN s >= (SELECT quantile_cont(s, 0.7) FROM t) THEN 1 ELSE 0 END AS top_produit FROM t""")
add("l4_class_balance", SCORED, """
SELECT top_produit, count(*) AS n, round(count(*) / (SELECT count(*) FROM enriched) * 100, 4) AS pct
FROM enriched GROUP BY top_produit""")
add("l5_matrix", FEATURES, f"""
SELECT uid, prix, remise_pct,
  CASE WHEN pk % 5 <> 0 THEN stock ELSE 0 END::DOUBLE AS stock, 0.0::DOUBLE AS nb_images,
  nb_variants::DOUBLE AS nb_variants, en_promo::DOUBLE AS en_promo,
  (dense_rank() OVER (ORDER BY categorie) - 1)::DOUBLE AS categorie_enc,
  (dense_rank() OVER (ORDER BY source) - 1)::DOUBLE AS source_enc FROM derived""")
add("l6_single_class", PRODUCTS, """
SELECT 1 AS classes, count(*) AS n, 0 AS models, 0.0::DOUBLE AS accuracy, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS cv_mean,
  0.0::DOUBLE AS cv_std FROM products""")
add("l7_split", SCORED + """,
sizes AS (SELECT top_produit, count(*) AS n FROM enriched GROUP BY 1),
tested AS (SELECT top_produit, n, CAST(floor((n - 1) * 0.2::DOUBLE) AS BIGINT) + 1 AS t FROM sizes)""", """
SELECT top_produit, true AS is_test, t AS n FROM tested UNION ALL SELECT top_produit, false, n - t FROM tested""")
add("l7_folds", SCORED + """,
sizes AS (SELECT top_produit, count(*) AS n FROM enriched GROUP BY 1),
marks AS (
  SELECT top_produit, n, k, CASE WHEN k = 0 THEN 0 WHEN k = 5 THEN n
    ELSE CAST(floor((n - 1) * (k / 5)) AS BIGINT) + 1 END AS m FROM sizes, range(6) r(k))""", """
SELECT a.top_produit, CAST(a.k AS INTEGER) AS fold, b.m - a.m AS n FROM marks a JOIN marks b
ON a.top_produit = b.top_produit AND b.k = a.k + 1""")

_CELLS = """
cells AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2),
classes AS (SELECT DISTINCT label AS c FROM cells),
report AS (
  SELECT c AS class, (SELECT sum(n) FROM cells WHERE label = c) AS support,
    coalesce((SELECT sum(n) FROM cells WHERE label = c AND prediction = c), 0) AS hit,
    (SELECT sum(n) FROM cells WHERE prediction = c) AS called FROM classes),
measured AS (
  SELECT class, coalesce(hit / called, 0) AS precision, hit / support AS recall, support FROM report),
full_report AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM measured)"""
add("l10_accuracy_f1", _CELLS, """
SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1
FROM full_report""")
add("l12_class_report", _CELLS, """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM full_report""")
add("l13_confusion", _CELLS, "SELECT label, prediction, n FROM cells")
add("l13_confusion_matrix", _CELLS, """
SELECT s.label, CAST(coalesce(sum(n) FILTER (prediction = 0), 0) AS BIGINT) AS pred_0,
  CAST(coalesce(sum(n) FILTER (prediction = 1), 0) AS BIGINT) AS pred_1
FROM (SELECT label FROM cells UNION SELECT prediction FROM cells) s LEFT JOIN cells ON cells.label = s.label GROUP BY s.label""")
add("l16_run_metrics", SCORED + "," + _CELLS, """
SELECT 'accuracy' AS metric, round(sum(recall * support) / sum(support), 6) AS value FROM full_report
UNION ALL SELECT 'f1_score', round(sum(f1 * support) / sum(support), 6) FROM full_report
UNION ALL SELECT 'nb_products', CAST(count(*) AS DOUBLE) FROM enriched
UNION ALL SELECT 'nb_top_products', CAST(sum(top_produit) AS DOUBLE) FROM enriched""")

# ---- rules

add("a1_clean_category", PRODUCTS, """
SELECT categorie, count(*) AS n FROM (
  SELECT CASE WHEN pk % 7 < 3 THEN 'inconnu' ELSE categorie END AS categorie FROM products) GROUP BY 1""")


def _group_baskets(group: str) -> str:
    return f"""
SELECT DISTINCT {group} AS basket, categorie AS item FROM products
WHERE {group} IN (SELECT {group} FROM products GROUP BY 1 HAVING count(DISTINCT categorie) >= 2)"""


_BINS = PRODUCTS + """,
q AS (SELECT quantile_cont(prix, 0.2) AS a, quantile_cont(prix, 0.4) AS b, quantile_cont(prix, 0.6) AS c,
  quantile_cont(prix, 0.8) AS d FROM products),
binned AS (
  SELECT CASE WHEN prix <= a THEN 0 WHEN prix <= b THEN 1 WHEN prix <= c THEN 2 WHEN prix <= d THEN 3 ELSE 4 END AS basket,
    categorie AS item FROM products, q)"""
add("a2_shop_baskets", PRODUCTS, _group_baskets("shop_url"))
add("a2_brand_baskets", PRODUCTS, _group_baskets("marque"))
add("a2_order_baskets", ORDERS, "SELECT basket, item FROM pairs")
add("a3_price_baskets", _BINS, """
SELECT DISTINCT basket, item FROM binned
WHERE basket IN (SELECT basket FROM binned GROUP BY 1 HAVING count(DISTINCT item) >= 2)""")
add("a4_plan", PRODUCTS, f"SELECT count(DISTINCT basket) AS baskets, 'A' AS plan FROM ({_group_baskets('shop_url')})")
add("a4_plan_few_shops", _BINS, """
SELECT count(*) AS baskets, 'C' AS plan FROM (
  SELECT basket FROM binned GROUP BY basket HAVING count(DISTINCT item) >= 2)""")
add("a5_vocabulary", counted(20), "SELECT basket, item FROM kept")
add("a6_frequent_sets", counted(50), """
SELECT a, b, n, baskets, round(support, 6) AS support FROM sets WHERE support >= 0.001""")
add("a6_frequent_sets_capped", counted(20), """
SELECT a, b, n, baskets, round(support, 6) AS support FROM sets WHERE support >= 0.001""")


def _ladder(start: float) -> str:
    steps, support = [], start
    while support <= 0.5:
        steps.append(support)
        support = round(support * 1.5, 3)
    return ", ".join(f"({i}, {s!r}::DOUBLE)" for i, s in enumerate(steps))


add("a7_support_ladder", counted(50), f"""
SELECT attempt, min_support, count(support) AS n_sets
FROM (VALUES {_ladder(0.005)}) t(attempt, min_support) LEFT JOIN sets ON support >= min_support GROUP BY 1, 2""")
add("a7_adaptive_support", counted(50), f"""
SELECT a, b, n, least_support AS min_support FROM sets JOIN (
  SELECT coalesce(min(min_support), 0.005) AS least_support FROM (VALUES {_ladder(0.005)}) t(attempt, min_support)
  WHERE min_support <= (SELECT max(support) FROM sets)) ON support >= least_support""")
_RULES = counted(50) + """,
ok AS (SELECT * FROM sets WHERE support >= 0.001),
ways AS (
  SELECT a AS antecedent, b AS consequent, support AS s FROM ok WHERE b IS NOT NULL
  UNION ALL SELECT b, a, support FROM ok WHERE b IS NOT NULL),
rated AS (
  SELECT antecedent, consequent, s AS support, x.support AS sa, y.support AS sc, s / x.support AS confidence,
    s / x.support / y.support AS lift
  FROM ways JOIN ok x ON x.a = antecedent AND x.b IS NULL JOIN ok y ON y.a = consequent AND y.b IS NULL),
good AS (SELECT * FROM rated WHERE confidence >= 0.05 AND lift >= 1.1)"""
add("a8_rules", _RULES, """
SELECT antecedent, consequent, round(support, 5) AS support, round(sa, 5) AS antecedent_support,
  round(sc, 5) AS consequent_support, round(confidence, 5) AS confidence, round(lift, 5) AS lift,
  round(support - sa * sc, 5) AS leverage, round((1 - sc) / (1 - confidence), 5) AS conviction,
  round((support - sa * sc) / greatest(support * (1 - sa), sa * (sc - support)), 5) AS zhangs_metric FROM good""")
add("a9_top_rules", _RULES, """
SELECT antecedent, consequent, round(support, 3) AS support, round(confidence, 3) AS confidence, round(lift, 3) AS lift
FROM good ORDER BY good.lift DESC, antecedent, consequent LIMIT 10""")

# ---- scores and ranks

add("t10_container_batch", PRODUCTS, """
SELECT 'scored' AS output, count(*) AS n FROM products
UNION ALL SELECT 'top_k', least(20, count(*)) FROM products UNION ALL SELECT 'metrics', 4""")

add("t1_min_max", PRODUCTS, """
SELECT uid, round((prix - min(prix) OVER ()) / (max(prix) OVER () - min(prix) OVER ()), 6) AS prix_01,
  0.0::DOUBLE AS constant_01 FROM products""")
add("t2_composite_score", SCORED, "SELECT uid, score_composite, rang FROM enriched")
add("t3_rank_any", PRODUCTS, "SELECT uid, rank() OVER (ORDER BY prix DESC) AS rang FROM products")
add("t4_score_summary", SCORED, """
SELECT round(avg(score_composite), 6) AS moyenne, max(score_composite) AS maximum FROM enriched""")
_SHOWN = """SELECT rang, nom, categorie, source, prix, rating, nb_reviews,
  remise_pct, disponible, score_composite, segment FROM enriched"""
_BEST = "ORDER BY score_composite DESC, uid"
add("t5_top_k", SCORED, f"{_SHOWN} {_BEST} LIMIT 20")
add("t5_top_k_filtered", SCORED,
    f"{_SHOWN} WHERE source = 'shopify' AND regexp_matches(categorie, '(?i)WIDGET|ring') {_BEST} LIMIT 20")
add("t6_container_score", PRODUCTS + """,
ends AS (
  SELECT min(rating / 5) AS lr, max(rating / 5) AS hr, min(1 / (prix + 1)) AS lp, max(1 / (prix + 1)) AS hp,
    min(remise_pct) AS ld, max(remise_pct) AS hd, min(stock) AS ls, max(stock) AS hs FROM products),
t AS (
  SELECT uid, round((rating / 5 - lr) / (hr - lr + 1e-9) * 40 + (1 / (prix + 1) - lp) / (hp - lp + 1e-9) * 30
    + (remise_pct - ld) / (hd - ld + 1e-9) * 20 + (stock - ls)::DOUBLE / (hs - ls + 1e-9) * 10, 2) AS score_composite
  FROM products, ends)""", "SELECT uid, score_composite, rank() OVER (ORDER BY score_composite DESC) AS rang FROM t")
add("t7_saved_top_k", SCORED, f"{_SHOWN} WHERE regexp_matches(categorie, '(?i)gizmo') {_BEST} LIMIT 10")
add("t7_saved_without_score", PRODUCTS, """
SELECT uid, nom, categorie FROM products WHERE regexp_matches(categorie, '(?i)gizmo') ORDER BY uid LIMIT 10""")
add("t8_segments", SCORED, "SELECT segment, count(*) AS n FROM enriched GROUP BY segment")
add("t9_status", PRODUCTS, """
SELECT count(*) AS raw_products, count(*) AS enriched_products, true AS raw_data_available,
  true AS enriched_data_available FROM products""")
add("t9_status_raw_only", PRODUCTS, """
SELECT count(*) AS raw_products, 0 AS enriched_products, true AS raw_data_available,
  false AS enriched_data_available FROM products""")
add("t9_overview", PRODUCTS, """
SELECT count(*) AS nb_products, 'categorie,date_creation,description,disponible,marque,nb_images,nb_reviews,'
  || 'nb_variants,nom,prix,product_id,rating,remise_pct,shop_url,source,stock,tags,uid' AS columns FROM products""")

# ---- dashboard

add("d1_filters", SCORED, """
SELECT uid, prix, remise_pct FROM enriched
WHERE source = 'shopify' AND categorie = 'standard gizmo' AND prix BETWEEN 20 AND 500 AND remise_pct > 0""")
add("d1_filters_top_available", SCORED, """
SELECT source, count(*) AS n FROM enriched WHERE top_produit = 1 AND disponible GROUP BY source""")
add("d2_filter_options", PRODUCTS, """
SELECT DISTINCT 'source' AS kind, source AS value FROM products
UNION SELECT DISTINCT 'categorie', categorie FROM products""")
add("d2_price_range", PRODUCTS, """
SELECT min(prix) AS prix_min, max(prix) AS prix_max FROM products""")
add("d3_side_stats", SCORED, """
SELECT count(*) AS produits, count(DISTINCT categorie) AS categories, CAST(sum(top_produit) AS BIGINT) AS top_ml FROM enriched""")
add("d4_kpis", SCORED, """
SELECT count(*) AS produits, count(DISTINCT source) AS sources, count(DISTINCT categorie) AS categories,
  CAST(sum(top_produit) AS BIGINT) AS top_n, round(sum(top_produit) / count(*) * 100, 4) AS top_pct,
  count(*) FILTER (remise_pct > 0) AS promo_n, round(avg(remise_pct) FILTER (remise_pct > 0), 4) AS remise_moyenne,
  round(avg(score_composite), 4) AS score_moyen, round(avg(prix), 4) AS prix_moyen, round(median(prix), 4) AS prix_median
FROM enriched""")
add("d5_top_bars", SCORED, f"""
SELECT uid, left(nom, 42) AS nom_court, categorie, prix, score_composite FROM enriched {_BEST} LIMIT 15""")
add("d5_top_bars_short", SCORED, f"""
SELECT uid, left(nom, 7) || '…' AS nom_court, categorie, prix, score_composite FROM enriched {_BEST} LIMIT 20""")
add("d6_segment_shares", SCORED, """
SELECT segment, count(*) AS n, round(count(*) / (SELECT count(*) FROM enriched) * 100, 4) AS pct FROM enriched GROUP BY segment""")
add("d7_availability", PRODUCTS, """
SELECT CASE WHEN disponible THEN 'Disponible' ELSE 'Rupture' END AS label, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM products) * 100, 4) AS pct FROM products GROUP BY 1""")
add("d8_category_volume", PRODUCTS, """
SELECT categorie, count(nom) AS n, round(avg(prix), 4) AS prix_moyen FROM products GROUP BY categorie
ORDER BY n DESC, categorie LIMIT 16""")


def _histogram(table: str, value: str) -> str:
    return f"""
SELECT bin, lo + bin * w AS debut, count(*) AS n FROM (
  SELECT lo, w, CAST(least(floor((v - lo) / w), 39) AS INTEGER) AS bin FROM (
    SELECT v, min(v) OVER () AS lo, (max(v) OVER () - min(v) OVER ()) / 40 AS w FROM (SELECT {value} AS v FROM {table})))
GROUP BY bin, lo, w"""


add("d9_score_histogram", SCORED, _histogram("enriched", "score_composite"))
add("d10_price_histogram", PRODUCTS + ", c AS (SELECT quantile_cont(prix, 0.95) AS top FROM products)",
    _histogram("products, c", "least(prix, top)"))
add("d11_ranked_products", SCORED, """
SELECT uid, remise_pct FROM enriched WHERE categorie = 'small ring'
ORDER BY enriched.remise_pct DESC, uid LIMIT 25""")
add("d12_formatted", SCORED, """
SELECT rang AS "#", nom AS "Produit", categorie AS "Catégorie", source AS "Source", '€' || format('{:.2f}', prix) AS "Prix",
  format('{:.1f}', remise_pct) || '%' AS "Remise", format('{:.2f}', score_composite) AS "Score",
  format('{:.1f}', rating) AS "Note", disponible AS "Dispo" FROM enriched""")
add("d13_segment_stats", SCORED, """
SELECT segment, round(avg(prix), 2) AS prix, round(avg(score_composite), 2) AS score_composite,
  round(avg(remise_pct), 2) AS remise_pct FROM enriched GROUP BY segment""")
add("d14_sample", SCORED, "SELECT uid, segment FROM enriched ORDER BY md5(uid || '_42'), uid LIMIT 900")
add("d15_scatter", PRODUCTS, """
SELECT source, count(*) AS n FROM products WHERE pk % 17 <> 0 AND pk % 23 <> 0 AND prix > 0 GROUP BY source""")
add("d16_price_stats", PRODUCTS, """
SELECT min(prix) AS minimum, round(avg(prix), 4) AS moyenne, max(prix) AS maximum,
  median(prix) AS mediane FROM products""")
add("d17_discount_spread", PRODUCTS + """,
promo AS (SELECT * FROM products WHERE remise_pct > 0),
big AS (SELECT categorie FROM promo GROUP BY 1 ORDER BY count(*) DESC, categorie LIMIT 7)""", """
SELECT categorie, count(*) AS n, round(min(remise_pct), 6) AS minimum, round(quantile_cont(remise_pct, 0.25), 6) AS q1,
  round(quantile_cont(remise_pct, 0.5), 6) AS mediane, round(quantile_cont(remise_pct, 0.75), 6) AS q3,
  round(max(remise_pct), 6) AS maximum FROM promo WHERE categorie IN (SELECT categorie FROM big) GROUP BY categorie""")
add("d18_best_ratio", SCORED, """
SELECT uid, nom, categorie, '€' || format('{:.2f}', prix) AS prix, format('{:.1f}', rating) AS rating,
  format('{:.1f}', remise_pct) || '%' AS remise_pct, format('{:.4f}', ratio_qualite_prix) AS ratio_qualite_prix
FROM enriched ORDER BY enriched.ratio_qualite_prix DESC, uid LIMIT 10""")
add("d19_search", SCORED, """
SELECT nom, categorie, source, prix, remise_pct, score_composite,
  rating, disponible, rang FROM enriched WHERE regexp_matches(nom, '(?i)^(RED|blue) .*g')""")
add("d20_last_entries", AUDIT, """
SELECT event_id, server_id, tool_name, status, left(action, 55) AS action, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS quand
FROM log ORDER BY timestamp DESC, event_id DESC LIMIT 15""")
add("d20_status_counts", AUDIT, "SELECT status, count(*) AS n FROM log GROUP BY status")

# ---- prompt facts

_FACTS = """
SELECT count(*) AS nb_produits, count(DISTINCT shop_url) AS nb_shops, count(DISTINCT categorie) AS nb_categories,
  format('{:.2f}', avg(prix)) AS prix_moyen, format('{:.2f}', median(prix)) AS prix_median,
  format('{:.2f}', min(prix)) AS prix_min, format('{:.2f}', max(prix)) AS prix_max,
  format('{:.1f}', count(*) FILTER (remise_pct > 0) / count(*) * 100) AS pct_promo,
  format('{:.1f}', avg(remise_pct) FILTER (remise_pct > 0)) AS remise_moyenne FROM enriched"""
_TOPCAT = "SELECT categorie, count(nom) AS n FROM products GROUP BY categorie ORDER BY n DESC, categorie LIMIT 5"
_LINE = """'  - ' || left(nom, 40) || ' (' || categorie || ') — ' || format('{:.0f}', prix) || '€ — score: '
  || format('{:.2f}', score_composite)"""
_TOP10 = f"""SELECT uid, row_number() OVER ({_BEST}) AS position, {_LINE} AS line FROM enriched {_BEST} LIMIT 10"""
_SEGS = """SELECT segment, count(*) AS n, '  - ' || segment || ': ' || count(*) || ' produits ('
  || format('{:.1f}', count(*) / (SELECT count(*) FROM enriched) * 100) || '%)' AS line FROM enriched GROUP BY segment"""
add("m1_context", SCORED, _FACTS)
add("m2_top_categories", PRODUCTS, _TOPCAT)
add("m3_top_products", SCORED, _TOP10)
add("m4_segment_lines", SCORED, _SEGS)
_PROFILES = """
SELECT s.segment, format('{:.2f}', avg(prix)) AS prix_moyen, format('{:.1f}', avg(remise_pct)) AS remise_moyenne,
  format('{:.2f}', avg(score_composite)) AS score_moyen, (
    SELECT string_agg('  - ' || left(nom, 40) || ' — ' || format('{:.0f}', prix) || '€', chr(10) ORDER BY score_composite DESC, uid)
    FROM (SELECT * FROM enriched e WHERE e.segment = s.segment ORDER BY score_composite DESC, uid LIMIT 5)) AS produits
FROM enriched s GROUP BY s.segment"""
add("m5_segment_profiles", SCORED, _PROFILES)


def _summaries(n: int) -> str:
    return f"""
SELECT uid, nom, categorie, format('{{:.2f}}', prix) AS prix, left(description, 800) AS description
FROM enriched WHERE length(description) > 20 {_BEST} LIMIT {n}"""


_MARKETING = f"""
SELECT uid, left(nom, 60) AS nom, categorie, shop_url, format('{{:.2f}}', prix) AS prix,
  format('{{:.1f}}', remise_pct) AS remise_pct, format('{{:.2f}}', score_composite) AS score_composite, segment,
  CAST(stock AS VARCHAR) AS stock, CASE WHEN en_promo = 1 THEN 'Oui' ELSE 'Non' END AS en_promo
FROM enriched ORDER BY enriched.score_composite DESC, uid LIMIT 10"""
_CHAT = f"""
SELECT count(*) AS nb_produits, format('{{:.2f}}', min(prix)) AS prix_min, format('{{:.2f}}', max(prix)) AS prix_max,
  format('{{:.1f}}', count(*) FILTER (remise_pct > 0) / count(*) * 100) AS pct_promo,
  format('{{:.2f}}', avg(score_composite)) AS score_moyen,
  (SELECT string_agg(DISTINCT source, ', ' ORDER BY source) FROM enriched) AS sources,
  (SELECT string_agg(c, ', ' ORDER BY c) FROM (SELECT DISTINCT categorie AS c FROM enriched ORDER BY c LIMIT 15))
    || CASE WHEN count(DISTINCT categorie) > 15 THEN '...' ELSE '' END AS categories,
  (SELECT string_agg('  ' || p || '. ' || left(nom, 40) || ' — ' || format('{{:.0f}}', prix) || '€ — score: '
      || format('{{:.2f}}', score_composite), chr(10) ORDER BY p)
   FROM (SELECT *, row_number() OVER ({_BEST}) AS p FROM enriched {_BEST} LIMIT 5)) AS top5
FROM enriched"""
add("m6_summary_candidates", SCORED, _summaries(50))
add("m7_marketing_rows", SCORED, _MARKETING)
add("m8_chat_context", SCORED, _CHAT)
add("m9_questions", SCORED + """,
cats AS (SELECT categorie AS c, count(*) AS n, avg(prix) AS px, avg(remise_pct) AS rem FROM enriched GROUP BY 1),
asked AS (
  SELECT 'Quelles promo sur ' || upper(split_part(c, ' ', 1)[1]) || split_part(c, ' ', 1)[2:] || ' '
    || upper(split_part(c, ' ', 2)[1]) || split_part(c, ' ', 2)[2:] || ' ?' AS question FROM cats
  UNION ALL SELECT 'Un ' || c || ' avec un petit budget' FROM cats
  UNION ALL SELECT 'Bonjour ' || left(c, 4) FROM cats),
hit AS (
  SELECT question, min(c) AS c FROM (SELECT DISTINCT question FROM asked) JOIN cats ON contains(lower(question), c) GROUP BY 1),
promo AS (SELECT string_agg(left(nom, 25) || ' (' || format('{:.0f}', remise_pct) || '%)', ', ' ORDER BY remise_pct DESC, uid) AS t
  FROM (SELECT * FROM enriched WHERE remise_pct > 0 ORDER BY remise_pct DESC, uid LIMIT 3)),
cheap AS (SELECT string_agg(left(nom, 25) || ' (' || format('{:.0f}', prix) || '€)', ', ' ORDER BY prix, uid) AS t
  FROM (SELECT * FROM enriched ORDER BY prix, uid LIMIT 3))""", """
SELECT md5(a.question) AS qid, a.question
  || coalesce(chr(10) || '[Données réelles pour ''' || hit.c || ''': ' || n || ' produits, prix moyen '
    || format('{:.0f}', px) || '€, remise moyenne ' || format('{:.1f}', rem) || '%]', '')
  || CASE WHEN contains(a.question, 'promo') THEN chr(10) || '[Top 3 remises: ' || promo.t || ']' ELSE '' END
  || CASE WHEN contains(a.question, 'budget') THEN chr(10) || '[Produits les moins chers: ' || cheap.t || ']' ELSE '' END
  AS enriched
FROM asked a LEFT JOIN hit ON hit.question = a.question LEFT JOIN cats ON cats.c = hit.c, promo, cheap""")
add("m10_memory", "", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 4""")
add("m11_suggestions", PRODUCTS, """
SELECT position, question FROM (VALUES
  (0, 'Quels sont les 5 meilleurs produits du dataset ?'),
  (1, 'Quelles sont les tendances principales détectées ?'),
  (3, 'Quels produits sont en promotion en ce moment ?'),
  (4, 'Quelle stratégie marketing recommandes-tu pour les top produits ?'),
  (5, 'Quels produits ont le meilleur rapport qualité/prix ?')) t(position, question)
UNION ALL SELECT 2, 'Analyse la catégorie ''' || min(categorie) || '''' FROM products""")

_NL = "' || chr(10) || '"
_RESUME = f"""'Rédige un court résumé commercial.{_NL}Produit : ' || nom || '{_NL}Catégorie : ' || categorie
  || '{_NL}Prix : ' || prix || '€{_NL}Description : ' || description"""
add("m12_prompts", SCORED, f"""
SELECT uid AS prompt_id, 'resume' AS kind, {_RESUME} AS text FROM ({_summaries(30)})
UNION ALL
SELECT 'tendances', 'tendances', 'Rédige un rapport de tendances.{_NL}' || nb_produits || ' produits, ' || nb_shops
  || ' boutiques, ' || nb_categories || ' catégories{_NL}Prix ' || prix_min || '€ à ' || prix_max || '€, moyen '
  || prix_moyen || '€, médian ' || prix_median || '€{_NL}Promotions ' || pct_promo || '%, remise ' || remise_moyenne
  || '%{_NL}Catégories :{_NL}' || (SELECT string_agg('  - ' || categorie || ' : ' || n || ' produits', chr(10)
      ORDER BY n DESC, categorie) FROM ({_TOPCAT}))
  || '{_NL}Produits :{_NL}' || (SELECT string_agg(line, chr(10) ORDER BY position) FROM ({_TOP10}))
  || '{_NL}Segments :{_NL}' || (SELECT string_agg(line, chr(10) ORDER BY n DESC, segment) FROM ({_SEGS}))
FROM ({_FACTS})
UNION ALL
SELECT uid, 'marketing', 'Propose un plan marketing.{_NL}' || nom || ' (' || categorie || ') chez ' || shop_url || '{_NL}'
  || prix || '€, remise ' || remise_pct || '%{_NL}Score ' || score_composite || ', segment ' || segment
  || '{_NL}Stock ' || stock || ', promo ' || en_promo FROM ({_MARKETING})
UNION ALL
SELECT 'assistant', 'assistant', 'Réponds à partir de ces faits.{_NL}' || nb_produits || ' produits, sources ' || sources
  || '{_NL}Catégories : ' || categories || '{_NL}Prix ' || prix_min || '€ à ' || prix_max || '€, promotions ' || pct_promo
  || '%, score moyen ' || score_moyen || '{_NL}' || top5 FROM ({_CHAT})
UNION ALL
SELECT segment, 'profil', 'Décris le client type.{_NL}Segment ' || segment || ' : prix ' || prix_moyen || '€, remise '
  || remise_moyenne || '%, score ' || score_moyen || '{_NL}' || produits FROM ({_PROFILES})""")
add("m13_attached", SCORED, f"""
SELECT enriched.uid, enriched.nom, coalesce(t.text, '') AS description_llm FROM enriched LEFT JOIN (
  SELECT uid, {_RESUME} AS text FROM ({_summaries(30)})) t ON t.uid = enriched.uid""")
add("m13_filled", SCORED, f"""
SELECT (SELECT count(*) FROM ({_summaries(30)})) AS n_done, count(*) AS n FROM enriched""")

# ---- audit and policy

add("u1_log_stats", AUDIT, """
SELECT 'total' AS level, '' AS value, count(*) AS n, round(avg(duration_ms), 2) AS avg_duration_ms FROM log
UNION ALL SELECT 'status', status, count(*), round(avg(duration_ms), 2) FROM log GROUP BY status
UNION ALL SELECT 'server', server_id, count(*), round(avg(duration_ms), 2) FROM log GROUP BY server_id""")
add("u2_recent", AUDIT, """
SELECT event_id, server_id, status, duration_ms FROM log ORDER BY timestamp DESC, event_id DESC LIMIT 20""")
add("u3_permission_check", AUDIT, "SELECT * FROM checked")
add("u4_denied", AUDIT, "SELECT * FROM checked WHERE reason IS NOT NULL")
add("u5_policy_summary", AUDIT, """
SELECT 3 AS servers_registered, 2 AS servers_approved, count(reason) AS total_denials FROM checked""")
add("u6_stream_counts", AUDIT, """
SELECT strftime(timestamp, '%Y-%m-%d') AS jour, status, count(*) AS n,
  CAST(sum(CAST(round(duration_ms * 100) AS BIGINT)) AS BIGINT) AS duration_cents FROM log GROUP BY 1, 2""")
