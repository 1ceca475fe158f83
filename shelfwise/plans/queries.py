"""Registered queries: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import features as fx
from shelfwise.functions.prices import discount, to_number
from shelfwise.functions.text import clean_name, html_to_text
from shelfwise.functions.urls import brand_from_url, category_from_url, stable_id
from shelfwise.operators import audit, classify, cluster, collect, density, evaluate, normalise
from shelfwise.operators import features as feat
from shelfwise.operators import rules, scoring, target
from shelfwise.operators.encode import ordinal_codes
from shelfwise.operators.quantiles import scalars
from shelfwise.operators.ranking import rank_descending
from shelfwise.operators.sizing import materialise
from shelfwise.plans import batch, dashboard, prompts
from shelfwise.schemas import PRODUCTS, REQUIRED, ensure_columns, required_columns
from shelfwise.sources import payloads, tables, views
from shelfwise.sources.landing import landed_path, path_exists
from shelfwise.sources.offers import build_products, products
from shelfwise.streaming.audit_counts import run_audit_counts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        REGISTRY[name] = f
        return f

    return register


def rounded(df: DataFrame, *columns: str, decimals: int = 6) -> DataFrame:
    """Doubles compared across engines are shown with fixed decimals."""
    return df.withColumns({c: F.round(c, decimals) for c in columns})


def _inputs(sf_dir: str) -> list[str]:
    return views.catalogue_inputs(sf_dir)


# ---- sources and sinks -------------------------------------------------------------


@query("s0_products")
def _(spark, d):
    return build_products(spark, d).drop("date_creation")


@query("s1_csv_read")
def _(spark, d):
    """Descriptions with line breaks and quotes survive the round trip."""
    path = landed_path(spark, "catalogue-csv", _inputs(d))
    if not path_exists(spark, f"{path}/_SUCCESS"):
        text = F.concat(F.col("nom"), F.lit(' \n "'), F.col("marque"), F.lit('", x'))
        tables.write_csv(products(spark, d).withColumn("description", text).select(PRODUCTS.names), path)
    back = tables.read_csv(spark, path, PRODUCTS)
    return back.select("uid", "nom", "description", "prix", "disponible", "stock")


@query("s2_shop_pages")
def _(spark, d):
    pages = payloads.read_shop_pages(spark, payloads.land_shop_payload(spark, d))
    return collect.shop_products(pages).select("shop_url", "id", "title", "product_type", "vendor")


@query("s3_store_pages")
def _(spark, d):
    rows = payloads.read_store_pages(spark, payloads.land_store_payload(spark, d))
    return rows.select("shop_url", "id", "name", "regular_price", "average_rating")


@query("s4_cards")
def _(spark, d):
    cards = payloads.read_cards(spark, payloads.land_cards(spark, d))
    return cards.where(F.length(F.trim("nom")) > 2).select("url", "position", "nom", "prix_raw", "image")


def _entries(spark, d) -> DataFrame:
    log = views.audit_log(spark, d)
    odd = F.col("event_id") % 10
    return log.select(
        "event_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "server_id", "tool_name", "action", "status",
        F.when(odd != 3, F.col("duration_ms") + 0.001).alias("duration_ms"),
        F.when(odd != 5, F.col("details")).alias("details"),
        F.when(odd != 7, F.col("error")).alias("error"),
    )


@query("s5_audit_read")
def _(spark, d):
    """Blank and broken lines between the entries are skipped."""
    path = landed_path(spark, "audit-broken", [f"{d}/events.parquet"])
    if not path_exists(spark, f"{path}/_SUCCESS"):
        e = audit.audit_entries(_entries(spark, d))
        good = F.to_json(F.struct(*e.columns))
        broken = F.concat(F.lit('{"timestamp": "'), "server_id")
        lines = F.when(F.col("duration_ms") < 10, F.array(good, F.lit(""), broken)).otherwise(F.array(good))
        e.select(F.explode(lines).alias("value")).write.mode("overwrite").text(path)
    return tables.read_audit(spark, path).select(
        "timestamp", "server_id", "tool_name", "status", "duration_ms", "error"
    )


@query("s6_audit_append")
def _(spark, d):
    """Two batches appended to one log, then read back."""
    # A path of its own for every attempt: a retry never appends to half of an earlier one.
    path = f"{landed_path(spark, 'audit-appended', [f'{d}/events.parquet'])}-{uuid.uuid4().hex}"
    raw = _entries(spark, d)
    for half in (0, 1):
        tables.append_audit(audit.audit_entries(raw.where(F.col("event_id") % 2 == half)), path)
    return tables.read_audit(spark, path)


@query("s7_csv_sink")
def _(spark, d):
    path = landed_path(spark, "export-csv", _inputs(d))
    if not path_exists(spark, f"{path}/_SUCCESS"):
        tables.write_csv(views.enriched(spark, d).select("uid", "nom", "rang", "score_composite"), path)
    back = tables.read_csv(
        spark, path, "uid string, nom string, rang int, score_composite double"
    )
    return back


@query("s8_saved_table")
def _(spark, d):
    """Saved twice: the second save replaces the first."""
    run = uuid.uuid4().hex
    name = f"shelfwise_products_{run}"
    path = f"{landed_path(spark, 'saved-table', _inputs(d))}-{run}"
    kept = products(spark, d).select("uid", "nom", "stock", "disponible")
    tables.save_table(kept.where("stock > 50"), name, path)
    tables.save_table(kept, name, path)
    return spark.table(name)


@query("s9_first_existing")
def _(spark, d):
    products(spark, d)
    stored = landed_path(spark, "products", _inputs(d))
    chosen = tables.load_catalogue(
        spark, [f"{d}/products_texts.parquet", f"{d}/products_enriched.parquet", stored],
        lambda: products(spark, d),
    )
    return chosen.groupBy("source").agg(F.count("*").alias("n"))


# ---- ingest ------------------------------------------------------------------------


def _shop(spark, d, negative=True):
    pages = payloads.read_shop_pages(spark, payloads.land_shop_payload(spark, d))
    return collect.flatten_shop(collect.shop_products(pages), negative)


def _store(spark, d):
    return collect.flatten_store(payloads.read_store_pages(spark, payloads.land_store_payload(spark, d)))


def _cards(spark, d, dedupe=True):
    return collect.flatten_cards(payloads.read_cards(spark, payloads.land_cards(spark, d)), dedupe)


@query("n1_shop_flatten")
def _(spark, d):
    return _shop(spark, d).select(
        "source", "shop_url", "product_id", "nom", "description", "categorie", "marque", "prix",
        "prix_compare", "disponible", "stock", "nb_images", "nb_variants",
    )


@query("n2_tags")
def _(spark, d):
    return _shop(spark, d).select("shop_url", "product_id", "tags")


@query("n3_discount")
def _(spark, d):
    return _shop(spark, d).select("shop_url", "product_id", "prix", "prix_compare", "remise_pct")


@query("n4_discount_guarded")
def _(spark, d):
    return _shop(spark, d, negative=False).select("shop_url", "product_id", "remise_pct")


@query("n5_html_text")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", html_to_text(F.col("html")).alias("description"))


@query("n5_html_text_whole")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    whole = html_to_text(F.col("html"), limit=None)
    return pages.select("page_id", F.length(whole).alias("n_chars"), F.md5(whole).alias("digest"))


@query("n6_store_flatten")
def _(spark, d):
    return _store(spark, d).drop("categorie", "tags", "remise_pct")


@query("n7_store_names")
def _(spark, d):
    return _store(spark, d).select("shop_url", "product_id", "categorie", "tags")


@query("n8_store_discount")
def _(spark, d):
    return _store(spark, d).select("shop_url", "product_id", "prix_regular", "prix_promo", "remise_pct")


@query("n9_card_price")
def _(spark, d):
    return _cards(spark, d, dedupe=False).select("shop_url", "position", "prix")


@query("n10_stable_id")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", stable_id(F.col("page_id").cast("string"), F.col("url")).alias("id"))


@query("n11_url_category")
def _(spark, d):
    cards = _cards(spark, d, dedupe=False).select("shop_url").distinct()
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("shop_url")).distinct()
    urls = cards.union(pages).distinct()
    return urls.select("shop_url", category_from_url(F.col("shop_url")).alias("categorie"))


@query("n12_url_brand")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", brand_from_url(F.col("url")).alias("marque"))


@query("n13_card_rows")
def _(spark, d):
    return _cards(spark, d, dedupe=False).drop("description", "tags", "date_creation")


@query("n14_card_dedupe")
def _(spark, d):
    return _cards(spark, d).select("shop_url", "nom", "position", "prix")


def _collected(spark, d):
    return collect.union_sources(_shop(spark, d), _store(spark, d), _cards(spark, d))


@query("n15_union")
def _(spark, d):
    return _collected(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.count("rating").alias("n_rating"),
        F.count("nb_variants").alias("n_variants"), F.count("prix_regular").alias("n_regular"),
        F.count("prix_compare").alias("n_compare"),
    )


@query("n16_required")
def _(spark, d):
    """Columns cut away are guaranteed again, null."""
    cut = products(spark, d).select("source", "shop_url", "product_id", "nom")
    full = required_columns(cut)
    return full.agg(
        F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in REQUIRED]
    )


def _dirty(spark, d):
    return payloads.dirty_catalogue(products(spark, d))


@query("n17_names")
def _(spark, d):
    return _dirty(spark, d).select("shop_url", "product_id", "seq", clean_name(F.col("nom")).alias("nom"))


@query("n18_n20_clean")
def _(spark, d):
    return normalise.clean_columns(_dirty(spark, d)).select(
        "shop_url", "product_id", "seq", "categorie", "prix", "remise_pct", "rating", "nb_reviews",
        "stock", "disponible",
    )


@query("n21_dedupe")
def _(spark, d):
    first = normalise.unique_products(_dirty(spark, d).select("shop_url", "product_id", "seq", "prix"))
    return first.select("shop_url", "product_id", "seq", "prix")


@query("n23_normalised")
def _(spark, d):
    return normalise.normalise_products(_dirty(spark, d)).select(
        "uid", "source", "shop_url", "product_id", "nom", "categorie", "prix", "remise_pct", "rating",
        "nb_reviews", "disponible", "stock",
    )


@query("n23_source_summary")
def _(spark, d):
    ordered = _collected(spark, d).withColumn("seq", F.coalesce("position", F.lit(0)))
    return normalise.source_summary(normalise.normalise_products(ordered.drop("position")))


# ---- features ----------------------------------------------------------------------

DERIVED = ("ratio_qualite_prix", "score_popularite")


@query("f1_f4_derived")
def _(spark, d):
    rows = feat.derive(products(spark, d))
    return rounded(rows.select("uid", *DERIVED, "en_promo", "segment_prix"), *DERIVED)


@query("f4_band_counts")
def _(spark, d):
    bands = products(spark, d).groupBy(fx.price_band(F.col("prix")).alias("segment_prix"))
    return bands.agg(F.count("*").alias("n")).withColumn(
        "ordre", fx.price_band_order(F.col("segment_prix"))
    )


@query("f5_label_codes")
def _(spark, d):
    holed = F.when(F.col("product_id").cast("long") % 19 != 0, F.col("categorie"))
    return ordinal_codes(products(spark, d).select(holed.alias("categorie")), "categorie")


def _holed(spark, d):
    part = F.col("product_id").cast("long")
    return products(spark, d).withColumns(
        {
            "rating": F.when(part % 17 != 0, F.col("rating")),
            "prix": F.when(part % 23 != 0, F.col("prix")),
            "stock": F.when(part % 5 != 0, F.col("stock")),
        }
    )


@query("f6_imputed")
def _(spark, d):
    rows = feat.impute_and_scale(feat.derive(_holed(spark, d)))
    return rounded(rows.select("uid", *feat.IMPUTED), *DERIVED)


@query("f7_scaled")
def _(spark, d):
    scaled = [f"{c}_norm" for c in feat.SCALED]
    rows = feat.impute_and_scale(feat.derive(_holed(spark, d)))
    return rounded(rows.select("uid", *scaled), *scaled)


@query("f8_container_features")
def _(spark, d):
    rows = feat.build_features_container(products(spark, d))
    scaled = [f"{c}_norm" for c in feat.SCALED_CONTAINER]
    return rounded(rows.select("uid", "categorie_enc", "source_enc", *scaled), *scaled)


@query("f9_features")
def _(spark, d):
    scaled = [f"{c}_norm" for c in feat.SCALED]
    rows = feat.build_features(products(spark, d))
    kept = ("uid", "en_promo", "segment_prix", "categorie_enc", "source_enc", *feat.IMPUTED, *scaled)
    return rounded(rows.select(*kept), *DERIVED, *scaled)


@query("f10_coercion")
def _(spark, d):
    numeric = ("prix", "remise_pct", "rating", "nb_reviews", "stock")
    return _dirty(spark, d).select(
        "shop_url", "product_id", "seq", *[to_number(F.col(c)).alias(c) for c in numeric]
    )


def _unscored(spark, d):
    return products(spark, d).select(
        "uid", "source", "categorie", "prix", "remise_pct", "rating", "disponible"
    )


@query("f11_fallback_score")
def _(spark, d):
    return scoring.fallback_score(_unscored(spark, d)).select("uid", "score_composite")


@query("f12_fallback_rank_label")
def _(spark, d):
    ranked = scoring.fallback_label(scoring.fallback_rank(scoring.fallback_score(_unscored(spark, d))))
    return ranked.select("uid", "rang", "top_produit")


@query("f13_score_bands")
def _(spark, d):
    scored = scoring.fallback_score(_unscored(spark, d))
    bands = scored.groupBy(fx.score_band(F.col("score_composite")).alias("segment"))
    return bands.agg(F.count("*").alias("n"))


@query("f14_fallback_columns")
def _(spark, d):
    table = scoring.dashboard_table(_unscored(spark, d))
    return table.select(
        "uid", "segment", "ratio_qualite_prix", "en_promo", "prix_norm", "remise_pct_norm"
    )


# ---- clusters, outliers, projection ------------------------------------------------


@query("c1_kmeans")
def _(spark, d):
    labelled, _ = cluster.run_kmeans(views.features(spark, d), k=4)
    return labelled.select("uid", "cluster_kmeans", "segment")


@query("c2_k_sweep")
def _(spark, d):
    return cluster.k_sweep(views.features(spark, d))


@query("c3_silhouette")
def _(spark, d):
    given = views.features(spark, d).withColumn("cluster_kmeans", (F.col("product_id").cast("long") % 4).cast("int"))
    value = cluster.silhouette(cluster.assemble(given), "cluster_kmeans")
    return given.agg(F.countDistinct("cluster_kmeans").alias("k")).withColumn("silhouette", F.round(F.lit(value), 6))


@query("c3_silhouette_sample")
def _(spark, d):
    given = views.features(spark, d).withColumn("cluster_kmeans", (F.col("product_id").cast("long") % 4).cast("int"))
    n, value = cluster.sampled_silhouette(given, "cluster_kmeans")
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.round(F.lit(value), 6).alias("silhouette"))


def _given_clusters(spark, d):
    return products(spark, d).withColumn(
        "cluster_kmeans", (F.col("product_id").cast("long") % 4).cast("int")
    )


@query("c4_cluster_profile")
def _(spark, d):
    return cluster.profile(_given_clusters(spark, d))


@query("c5_cluster_names")
def _(spark, d):
    given = _given_clusters(spark, d)
    named = cluster.attach_names(given, cluster.name_clusters(cluster.profile(given)))
    return named.groupBy("cluster_kmeans", "segment").agg(F.count("*").alias("n"))


@query("c6_dbscan")
def _(spark, d):
    return views.outlined(spark, d).select("uid", "cluster_dbscan", "is_anomalie")


@query("c6_outliers")
def _(spark, d):
    return views.outlined(spark, d).select("uid", "is_anomalie")


@query("c7_outlier_counts")
def _(spark, d):
    return density.outlier_counts(views.outlined(spark, d))


@query("c8_pca")
def _(spark, d):
    coords, explained = cluster.project(views.features(spark, d))
    return rounded(coords.select("uid", "PC1", "PC2"), "PC1", "PC2").withColumn(
        "explained", F.lit(explained)
    )


@query("c9_container_kmeans")
def _(spark, d):
    bare = products(spark, d).select("uid", "prix", "rating").transform(
        lambda t: feat.impute_and_scale(t, (), ("prix", "rating"))
    )
    return cluster.container_kmeans(bare).select("uid", "cluster")


# ---- label, models, evaluation -----------------------------------------------------


@query("l1_target")
def _(spark, d):
    return target.create_target(products(spark, d)).select("uid", "top_produit")


@query("l2_flat_guard")
def _(spark, d):
    """All rows alike: the label comes from key-based noise."""
    flat = products(spark, d).select(
        "uid", F.lit(10.0).alias("prix"), F.lit(0.0).alias("remise_pct"), F.lit(True).alias("disponible"),
        F.lit(0).alias("stock"),
    )
    labelled = target.create_target(flat)
    return labelled.agg(F.count("*").alias("n"), F.sum("top_produit").cast("long").alias("top_n"))


@query("l3_container_target")
def _(spark, d):
    shifted = products(spark, d).withColumn("remise_pct", F.col("remise_pct") - 1.0)
    return target.container_target(shifted).select("uid", "top_produit")


@query("l4_class_balance")
def _(spark, d):
    return target.class_balance(views.enriched(spark, d))


@query("l5_matrix")
def _(spark, d):
    lacking = views.features(spark, d).drop("nb_images").withColumn(
        "stock", F.when(F.col("product_id").cast("long") % 5 != 0, F.col("stock"))
    )
    rows = target.feature_matrix(lacking)
    return rows.select("uid", *target.CLASS_FEATURES)


@query("l6_single_class")
def _(spark, d):
    """Three quarters of all rows share the lowest score, so the 70 % cut takes every row: one class, nothing is trained."""
    cheap = F.col("product_id").cast("long") % 4 == 0
    same = products(spark, d).select(
        "uid", F.when(cheap, 10.0).otherwise(100.0).alias("prix"), F.lit(0.0).alias("remise_pct"), F.lit(0).alias("stock"),
    )
    results, labelled, models = classify.train_and_evaluate(same)
    counted = labelled.agg(F.countDistinct("top_produit").alias("classes"), F.count("*").alias("n"), F.lit(len(models)).alias("models"))
    return counted.select("classes", "n", "models", *[F.lit(v).alias(k) for k, v in results["xgboost"].items()])


@query("l7_split")
def _(spark, d):
    split = target.stratified_split(views.enriched(spark, d).select("uid", "top_produit"))
    return split.groupBy("top_produit", "is_test").agg(F.count("*").alias("n"))


@query("l7_folds")
def _(spark, d):
    marked = target.stratified_folds(views.enriched(spark, d).select("uid", "top_produit"), "top_produit")
    return marked.groupBy("top_produit", "fold").agg(F.count("*").alias("n"))


@query("l8_l15_models")
def _(spark, d):
    """Both models on the whole table; probabilities per product."""
    _, scored, _ = classify.train_and_evaluate(views.features(spark, d), cv=False)
    return scored.select("uid", "top_produit", "proba_top_xgb", "proba_top_rf", "proba_consensus")


@query("l14_importance")
def _(spark, d):
    """Of the boosted trees, fitted on the training part."""
    return classify.importance(classify.boosted_of(views.enriched(spark, d)))


@query("l11_cross_validation")
def _(spark, d):
    """Weighted F1 over five stratified folds of the training part: mean and deviation of both models."""
    return classify.metrics_table(spark, classify.cross_validated(views.enriched(spark, d)))


def _judged(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


@query("l10_accuracy_f1")
def _(spark, d):
    return rounded(evaluate.accuracy_and_f1(evaluate.confusion(_judged(spark, d))), "accuracy", "f1")


@query("l12_class_report")
def _(spark, d):
    report = evaluate.class_report(evaluate.confusion(_judged(spark, d)))
    return rounded(report, "precision", "recall", "f1")


@query("l13_confusion")
def _(spark, d):
    return evaluate.confusion(_judged(spark, d))


@query("l13_confusion_matrix")
def _(spark, d):
    return evaluate.confusion_matrix(_judged(spark, d))


@query("l16_run_metrics")
def _(spark, d):
    judged = _judged(spark, d)
    acc, f1 = evaluate.accuracy_and_f1_values(judged, "label", "prediction")
    return rounded(evaluate.run_metrics(views.enriched(spark, d), acc, f1), "value")


# ---- rules -------------------------------------------------------------------------


def _orders(spark, d) -> DataFrame:
    return rules.baskets(views.order_items(spark, d), "l_orderkey")


@query("a1_clean_category")
def _(spark, d):
    part = F.col("product_id").cast("long")
    odd = (
        F.when(part % 7 == 0, F.lit(None).cast("string")).when(part % 7 == 1, " NaN ")
        .when(part % 7 == 2, "").otherwise(F.upper("categorie"))
    )
    cleaned = products(spark, d).select(rules.clean_category(odd).alias("categorie"))
    return cleaned.groupBy("categorie").agg(F.count("*").alias("n"))


@query("a2_shop_baskets")
def _(spark, d):
    return rules.baskets(products(spark, d), "shop_url")


@query("a2_brand_baskets")
def _(spark, d):
    return rules.baskets(products(spark, d), "marque", rules.OTHER_SKIPPED)


@query("a2_order_baskets")
def _(spark, d):
    return _orders(spark, d)


@query("a3_price_baskets")
def _(spark, d):
    return rules.price_baskets(products(spark, d))


@query("a4_plan")
def _(spark, d):
    """Plan used per number of shops: all of them, then one shop name for all."""
    plan, n, pairs = rules.choose_baskets(products(spark, d))
    return pairs.select("basket").distinct().agg(F.count("*").alias("baskets")).withColumn("plan", F.lit(plan))


@query("a4_plan_few_shops")
def _(spark, d):
    one = products(spark, d).withColumns({"shop_url": F.lit("one"), "marque": F.lit("one")})
    plan, n, pairs = rules.choose_baskets(one)
    return pairs.select("basket").distinct().agg(F.count("*").alias("baskets")).withColumn("plan", F.lit(plan))


@query("a5_vocabulary")
def _(spark, d):
    return rules.limit_vocabulary(_orders(spark, d), 20)


def _counts(spark, d, items=rules.MAX_ITEMS):
    return materialise(rules.pair_counts(_orders(spark, d), items))


@query("a6_frequent_sets")
def _(spark, d):
    return rounded(rules.frequent_sets(_counts(spark, d), 0.001), "support")


@query("a6_frequent_sets_capped")
def _(spark, d):
    return rounded(rules.frequent_sets(_counts(spark, d, 20), 0.001), "support")


@query("a7_support_ladder")
def _(spark, d):
    return rules.support_ladder(_counts(spark, d), 0.005)


@query("a7_adaptive_support")
def _(spark, d):
    counts = materialise(_counts(spark, d))
    support = rules.adaptive_support(counts, 0.005)
    return rules.frequent_sets(counts, support).select("a", "b", "n", F.lit(support).alias("min_support"))


@query("a8_rules")
def _(spark, d):
    found = rules.rules_from_counts(_counts(spark, d), 0.001, 0.05, 1.1)
    measures = [c for c in found.columns if c not in ("antecedent", "consequent")]
    return rounded(found, *measures, decimals=5)


@query("a9_top_rules")
def _(spark, d):
    return rules.top_rules(rules.rules_from_counts(_counts(spark, d), 0.001, 0.05, 1.1))


# ---- scores and ranks --------------------------------------------------------------


@query("t1_min_max")
def _(spark, d):
    table = products(spark, d)
    b = scalars(table, lo=F.min("prix"), hi=F.max("prix"))
    return rounded(
        table.select(
            "uid", fx.min_max(F.col("prix"), b["lo"], b["hi"]).alias("prix_01"),
            fx.min_max(F.lit(3.0), 3.0, 3.0).alias("constant_01"),
        ),
        "prix_01",
    )


@query("t2_composite_score")
def _(spark, d):
    scored = scoring.composite_score(views.features(spark, d))
    return scored.select("uid", "score_composite", "rang")


@query("t3_rank_any")
def _(spark, d):
    """Rank over unrounded values, no bound on their number."""
    return rank_descending(products(spark, d).select("uid", "prix"), "prix", "rang").select("uid", "rang")


@query("t4_score_summary")
def _(spark, d):
    return scoring.score_summary(views.enriched(spark, d))


def _top(df):
    return scoring.display_columns(df)


@query("t5_top_k")
def _(spark, d):
    return _top(scoring.filtered_top_k(views.enriched(spark, d), 20))


@query("t5_top_k_filtered")
def _(spark, d):
    return _top(scoring.filtered_top_k(views.enriched(spark, d), 20, "WIDGET|ring", "shopify"))


@query("t6_container_score")
def _(spark, d):
    """The given rating stands in for the model's probability."""
    table = products(spark, d).withColumn("proba_top", F.col("rating") / 5)
    return scoring.container_score(table).select("uid", "score_composite", "rang")


@query("t7_saved_top_k")
def _(spark, d):
    return _top(scoring.filtered_top_k(views.enriched(spark, d), 10, "gizmo"))


@query("t7_saved_without_score")
def _(spark, d):
    return scoring.filtered_top_k(products(spark, d), 10, "gizmo").select("uid", "nom", "categorie")


@query("t8_segments")
def _(spark, d):
    return scoring.segment_counts(views.enriched(spark, d))


@query("t9_status")
def _(spark, d):
    return scoring.table_status(products(spark, d), views.enriched(spark, d))


@query("t9_status_raw_only")
def _(spark, d):
    return scoring.table_status(products(spark, d), None)


@query("t9_overview")
def _(spark, d):
    return scoring.table_overview(products(spark, d).select(sorted(PRODUCTS.names)))


@query("t10_batch")
def _(spark, d):
    return batch.registered_run(spark, d)


@query("t10_container_batch")
def _(spark, d):
    return batch.registered_container_run(spark, d)


# ---- dashboard ---------------------------------------------------------------------


@query("d1_filters")
def _(spark, d):
    kept = dashboard.filter_products(
        views.enriched(spark, d), source="shopify", categorie="standard gizmo", prix_min=20, prix_max=500,
        promo_only=True,
    )
    return kept.select("uid", "prix", "remise_pct")


@query("d1_filters_top_available")
def _(spark, d):
    kept = dashboard.filter_products(views.enriched(spark, d), top_only=True, available_only=True)
    return kept.groupBy("source").agg(F.count("*").alias("n"))


@query("d2_filter_options")
def _(spark, d):
    return dashboard.filter_options(products(spark, d))


@query("d2_price_range")
def _(spark, d):
    return dashboard.price_range(products(spark, d))


@query("d3_side_stats")
def _(spark, d):
    return dashboard.side_stats(views.enriched(spark, d))


@query("d4_kpis")
def _(spark, d):
    return dashboard.kpi_row(views.enriched(spark, d))


@query("d5_top_bars")
def _(spark, d):
    return dashboard.top_bars(views.enriched(spark, d))


@query("d5_top_bars_short")
def _(spark, d):
    return dashboard.top_bars(views.enriched(spark, d), 20, 7, True)


@query("d6_segment_shares")
def _(spark, d):
    return dashboard.segment_shares(views.enriched(spark, d))


@query("d7_availability")
def _(spark, d):
    return dashboard.availability(products(spark, d))


@query("d8_category_volume")
def _(spark, d):
    return dashboard.category_volume(products(spark, d))


@query("d9_score_histogram")
def _(spark, d):
    return dashboard.score_histogram(views.enriched(spark, d))


@query("d10_price_histogram")
def _(spark, d):
    return dashboard.price_histogram(products(spark, d))


@query("d11_ranked_products")
def _(spark, d):
    rows = dashboard.ranked_products(views.enriched(spark, d), 25, "remise_pct", "small ring")
    return rows.select("uid", "remise_pct")


@query("d12_formatted")
def _(spark, d):
    return dashboard.formatted(views.enriched(spark, d))


@query("d13_segment_stats")
def _(spark, d):
    return dashboard.segment_stats(views.enriched(spark, d))


@query("d14_sample")
def _(spark, d):
    return dashboard.fixed_sample(views.enriched(spark, d), 900).select("uid", "segment")


@query("d15_scatter")
def _(spark, d):
    kept = dashboard.scatter_rows(_holed(spark, d))
    return kept.groupBy("source").agg(F.count("*").alias("n"))


@query("d16_price_stats")
def _(spark, d):
    return dashboard.price_stats(products(spark, d))


@query("d17_discount_spread")
def _(spark, d):
    return dashboard.discount_spread(products(spark, d))


@query("d18_best_ratio")
def _(spark, d):
    return dashboard.best_ratio(views.enriched(spark, d))


@query("d19_search")
def _(spark, d):
    return dashboard.search_products(views.enriched(spark, d), "^(RED|blue) .*g")


@query("d20_last_entries")
def _(spark, d):
    last = audit.recent(views.audit_log(spark, d), 15)
    return last.select(
        "event_id", "server_id", "tool_name", "status", F.substring("action", 1, 55).alias("action"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("quand"),
    )


@query("d20_status_counts")
def _(spark, d):
    return audit.status_counts(views.audit_log(spark, d))


# ---- prompt facts ------------------------------------------------------------------


@query("m1_context")
def _(spark, d):
    return prompts.catalogue_context(views.enriched(spark, d))


@query("m2_top_categories")
def _(spark, d):
    return prompts.top_categories(products(spark, d))


@query("m3_top_products")
def _(spark, d):
    return prompts.top_products(views.enriched(spark, d))


@query("m4_segment_lines")
def _(spark, d):
    return prompts.segment_lines(views.enriched(spark, d))


@query("m5_segment_profiles")
def _(spark, d):
    return prompts.segment_profiles(views.enriched(spark, d))


@query("m6_summary_candidates")
def _(spark, d):
    return prompts.summary_candidates(views.enriched(spark, d))


@query("m7_marketing_rows")
def _(spark, d):
    return prompts.marketing_rows(views.enriched(spark, d))


@query("m8_chat_context")
def _(spark, d):
    return prompts.chat_context(views.enriched(spark, d))


@query("m9_questions")
def _(spark, d):
    return prompts.enrich_questions(views.questions(spark, d), views.enriched(spark, d))


@query("m10_memory")
def _(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    return prompts.sliding_memory(turns, 2)


@query("m11_suggestions")
def _(spark, d):
    return prompts.suggested_questions(products(spark, d))


@query("m12_prompts")
def _(spark, d):
    return prompts.all_prompts(views.enriched(spark, d))


@query("m13_attached")
def _(spark, d):
    table = views.enriched(spark, d)
    texts = prompts.render(prompts.summary_candidates(table, 30), "resume", "uid")
    written = texts.select(F.col("prompt_id").alias("uid"), "text")
    return prompts.attach_texts(table.select("uid", "nom"), written)


@query("m13_filled")
def _(spark, d):
    table = views.enriched(spark, d)
    texts = prompts.summary_candidates(table, 30).select("uid", F.col("description").alias("text"))
    return prompts.filled_count(prompts.attach_texts(table.select("uid"), texts))


# ---- audit and policy --------------------------------------------------------------


@query("u1_log_stats")
def _(spark, d):
    return audit.log_stats(views.audit_log(spark, d))


@query("u2_recent")
def _(spark, d):
    return audit.recent(views.audit_log(spark, d), 20).select("event_id", "server_id", "status", "duration_ms")


def _requests(spark, d):
    return views.audit_log(spark, d).select("event_id", "server_id", "permission", "action")


@query("u3_permission_check")
def _(spark, d):
    return audit.check_permissions(_requests(spark, d), views.manifests(spark))


@query("u4_denied")
def _(spark, d):
    return audit.denied(_requests(spark, d), views.manifests(spark))


@query("u5_policy_summary")
def _(spark, d):
    return audit.policy_summary(_requests(spark, d), views.manifests(spark))


@query("u6_stream_counts")
def _(spark, d):
    """Daily counts by status, kept by a stream over several files in mixed order of time."""
    events = spark.read.parquet(f"{d}/events.parquet")
    path = landed_path(spark, "audit-stream", [f"{d}/events.parquet"])
    if not path_exists(spark, f"{path}/in/_SUCCESS"):
        events.repartition(4, F.xxhash64("event_id")).write.mode("overwrite").parquet(f"{path}/in")
    state = run_audit_counts(
        spark, f"{path}/in", events.schema, views.stream_shape, f"{path}/out", files_per_batch=1
    )
    return state.select(
        views.utc_day(F.col("window_start")).alias("jour"), "status", "n", "duration_cents"
    )
