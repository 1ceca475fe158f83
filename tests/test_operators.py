"""Edge rules on small hand-made tables."""

import gzip
import json
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import features as fx
from shelfwise.functions.prices import discount, parse_price, to_count, to_number, to_truth
from shelfwise.functions.text import clean_name, fixed, html_to_text
from shelfwise.functions.urls import brand_from_url, category_from_url
from shelfwise.operators import cluster, collect, evaluate, normalise, rules, scoring, sizing, target
from shelfwise.operators import components as component_steps
from shelfwise.operators.components import components
from shelfwise.operators.encode import label_encode
from shelfwise.operators.features import impute_and_scale
from shelfwise.operators.quantiles import quantiles
from shelfwise.operators.ranking import first_per_key, rank_descending
from shelfwise.schemas import PRODUCTS
from shelfwise.sources import generators, payloads, tables
from shelfwise.sources.landing import folders, settings


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,expected",
    [("€ 12,50", 12.5), ("1.234,56 €", 1234.56), ("n/a", 0.0), ("", 0.0), (None, 0.0), ("..", 0.0),
     ("1,234.5", 1234.5), ("$90", 90.0)],
)
def test_parse_price(spark, raw, expected):
    assert one(spark, parse_price(F.col("v").cast("string")), v=raw) == expected


@pytest.mark.parametrize(
    "raw,number", [("10.5", 10.5), (" 7 ", 7.0), ("n/a", 0.0), (None, 0.0), ("5d", 0.0), ("nan", 0.0)]
)
def test_to_number(spark, raw, number):
    assert one(spark, to_number(F.col("v").cast("string")), v=raw) == number


def test_counts_are_cut_and_truth_is_text(spark):
    assert one(spark, to_count(F.col("v")), v="12.9") == 12
    assert [one(spark, to_truth(F.col("v")), v=v) for v in ("Oui", "1", "1.0", "no", True)] == [
        True, True, False, False, True,
    ]


def test_discount_with_and_without_negative(spark):
    above = dict(p=120.0, c=100.0)
    assert one(spark, discount(F.col("p"), F.col("c")), **above) == -20.0
    assert one(spark, discount(F.col("p"), F.col("c"), False), **above) == 0.0
    assert one(spark, discount(F.col("p"), F.col("c")), p=50.0, c=0.0) == 0.0


def test_names_and_text(spark):
    assert one(spark, clean_name(F.col("v")), v="  t-shirt  l'eau 3XL élan ") == "T-Shirt L'Eau 3Xl Élan"
    html = "<style>p{}</style><p>a<b>b</b></p>\n<p>c &amp; &eacute;&#233;&#xe9; &#8364;</p><script>'</p>'</script>"
    assert one(spark, html_to_text(F.col("v")), v=html) == "a b \n c & ééé €"
    assert one(spark, html_to_text(F.col("v").cast("string")), v=None) == ""
    assert one(spark, html_to_text(F.col("v")), v="&Eacute;t&eacute; &auml; &ntilde; &pound;5") == "Été ä ñ £5"
    assert one(spark, html_to_text(F.col("v")), v="&#38;lt;b &amp;amp; &no; & &#0; &#xD800;") == "&lt;b &amp; &no; & &#0; &#xD800;"
    assert one(spark, html_to_text(F.col("v")), v="<a title=\"x>y\" b='>' c=1>t</a><i d=\">u</i> it's <3") == "t u  it's <3"
    assert one(spark, F.length(html_to_text(F.repeat(F.col("v"), 400))), v="<p>xyz</p>") == 500


def test_fixed_is_half_even(spark):
    values = [0.125, 36.5, 1.005, 1234567.891]
    assert [one(spark, fixed(F.col("v"), 2), v=v) for v in values] == [f"{v:.2f}" for v in values]
    assert one(spark, fixed(F.col("v"), 0), v=36.5) == "36"


def test_urls(spark):
    assert one(spark, category_from_url(F.col("v")), v="https://x.com/women") == "Homme"
    assert one(spark, category_from_url(F.col("v")), v="https://x.com/new") == "Mode"
    assert one(spark, brand_from_url(F.col("v")), v="https://www.allBirds.com/a") == "Allbirds"


def test_price_bands_are_right_closed(spark):
    got = [one(spark, fx.price_band(F.col("v")), v=v) for v in (0.0, 20.0, 20.01, 100.0, 200.0, 201.0)]
    assert got == [None, "très_bas", "bas", "moyen", "élevé", "premium"]


def test_score_bands(spark):
    got = [one(spark, fx.score_band(F.col("v")), v=v) for v in (0.0, 30.0, 70.0, 100.0, 101.0, -1.0)]
    assert got == ["Entrée gamme", "Entrée gamme", "Bestseller", "Premium", "nan", "nan"]


@pytest.mark.parametrize("small", [5, 50, 100_000])
@pytest.mark.parametrize("kind", ["uniform", "ties", "two", "skewed"])
def test_quantiles_equal_numpy(spark, kind, small):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.uniform(0, 1, 3000),
        "ties": rng.integers(0, 7, 3000).astype(float),
        "two": (rng.uniform(0, 1, 3000) < 0.3).astype(float),
        "skewed": np.concatenate([np.zeros(1000), rng.lognormal(3, 2, 2000)]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    wanted = [0.0, 0.2, 0.5, 0.7, 0.95, 1.0]
    got = quantiles(df, {"v": wanted}, small=small)["v"]
    for q in wanted:
        assert got[q] == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([(None,)], "v double"), {"v": [0.5]})["v"][0.5] is None


@pytest.mark.parametrize("bound", [None, 10_001])
def test_rank_ties_take_the_minimum(spark, bound):
    df = spark.createDataFrame([(s,) for s in (30.0, 30.0, 29.96, 12.5, 12.5, 12.0, -3.0)], "s double")
    ranks = [r["rang"] for r in rank_descending(df, "s", "rang", bound).orderBy(F.desc("s")).collect()]
    assert ranks == [1, 1, 3, 4, 4, 6, 7]


def test_rank_split_into_ranges(spark, monkeypatch):
    from shelfwise.operators import ranking

    monkeypatch.setattr(ranking, "PART_VALUES", 40)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.uniform(0, 1, 300), rng.integers(0, 9, 200)]).round(3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, s double")
    got = {r["i"]: r["rang"] for r in rank_descending(df, "s", "rang").collect()}
    assert got == {i: int((values > v).sum()) + 1 for i, v in enumerate(values)}


def test_first_per_key_keeps_columns_and_order(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 5, "z")], "k string, seq int, v string")
    got = {(r["k"], r["seq"], r["v"]) for r in first_per_key(df, ["k"], ["seq"]).collect()}
    assert got == {("a", 1, None), ("b", 5, "z")}


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    got = [(r["c"], r["e"]) for r in label_encode(df, "c", "e").orderBy("e").collect()]
    assert got == [("a", 0), ("b", 1), ("b", 1), (None, 2)]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    rows = impute_and_scale(df, ("a", "b"), ("a", "b")).collect()
    assert {r["a_norm"] for r in rows} == {0.0}
    assert sorted(r["b_norm"] for r in rows) == [0.0, 0.5, 1.0]


def test_shop_payload_fixture(spark, tmp_path):
    product = {
        "id": 8071, "title": " Lampe Orion ", "body_html": "<div>Verre <i>soufflé</i></div>", "product_type": "Luminaires",
        "vendor": "Atelier Sud", "tags": ["salon", "verre", "led"],
        "variants": [{"price": "60.00", "compare_at_price": "75.00", "available": True, "inventory_quantity": 7}],
        "created_at": "2025-03-09", "updated_at": "2025-04-11", "images": [{"src": "lampe-1.png"}, {"src": "lampe-2.png"}],
    }
    bare = {"id": 9, "title": "Bare", "variants": [], "images": []}
    folder = tmp_path / "shop_url=https%3A%2F%2Flampes.example%2F"
    folder.mkdir()
    (folder / "p.json").write_text(json.dumps({"products": [product, bare]}) + "\n" + json.dumps({"products": []}))
    pages = payloads.read_shop_pages(spark, str(tmp_path))
    rows = {r["product_id"]: r for r in collect.flatten_shop(collect.shop_products(pages)).collect()}
    assert len(rows) == 2
    r = rows["8071"]
    assert (r["nom"], r["prix"], r["remise_pct"], r["tags"], r["shop_url"]) == (
        "Lampe Orion", 60.0, 20.0, "salon, verre, led", "https://lampes.example",
    )
    assert (rows["9"]["prix"], rows["9"]["nb_variants"], rows["9"]["disponible"]) == (0.0, 0, False)


def test_store_payload_fixture(spark, tmp_path):
    product = {
        "id": 31, "name": "Théière Cobalt", "description": "<span>Grès</span>", "short_description": "<b>1 l</b>",
        "price": "27.00", "regular_price": "36.00", "sale_price": "27.00", "average_rating": "3.8",
        "rating_count": 14, "in_stock": True, "stock_quantity": None, "total_sales": 62, "weight": "0.9",
        "date_created": "2025-06-30", "images": [{"src": "t.png"}], "categories": [{"name": "Cuisine"}, {"name": "Thé"}],
        "tags": [{"name": "bleu"}],
    }
    folder = tmp_path / "shop_url=vaisselle"
    folder.mkdir()
    (folder / "p.json").write_text(json.dumps([product, {**product, "id": 32}], indent=1))
    rows = collect.flatten_store(payloads.read_store_pages(spark, str(tmp_path), multi_line=True)).collect()
    assert len(rows) == 2
    assert (rows[0]["prix"], rows[0]["rating"], rows[0]["remise_pct"]) == (27.0, 3.8, 25.0)
    assert (rows[0]["categorie"], rows[0]["stock"], rows[0]["description"]) == ("Cuisine, Thé", 0, "Grès")


def test_csv_files_hold_bounded_rows(spark, tmp_path, monkeypatch):
    """A file can't be split, so no file may grow with the table."""
    monkeypatch.setattr(tables, "CSV_ROWS", 10)
    rows = spark.range(95).coalesce(1).select("id", F.lit('a \n "b", c').alias("text"))
    tables.write_csv(rows, str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("*.csv"))
    assert len(parts) == 10
    back = tables.read_csv(spark, str(tmp_path / "out"), rows.schema)
    assert sorted(map(tuple, back.collect())) == [(i, 'a \n "b", c') for i in range(95)]


def test_payload_files_do_not_grow_with_shops(spark, tmp_path):
    """No folder a shop; the documents name the shops, a shop without a name is null."""
    names = [f"Shop / {i}" for i in range(40)] + ["", None]
    for source, payload in (("shopify", payloads.shop_payload), ("woocommerce", payloads.store_payload)):
        rows = [
            (s, str(i), f"u{i}", f"n{i}", None, "c", "m", "t", 1.0, 0.0, 4.0, 30, True, 5, 1, 1, "2025-01-01", source)
            for i, s in enumerate(names)
        ]
        given = tmp_path / f"{source}.txt"
        given.write_text("given")
        path = payloads._landed_text(spark, f"few-{source}", [str(given)], lambda: payload(spark.createDataFrame(rows, PRODUCTS)))
        assert folders(spark, path) == []
        if source == "shopify":
            back = collect.shop_products(payloads.read_shop_pages(spark, path))
        else:
            back = payloads.read_store_pages(spark, path)
        got = {(r["shop_url"], r["id"]) for r in back.collect()}
        assert got == {(s or None, i) for i, s in enumerate(names)}


def test_labels_go_to_the_edges(spark, monkeypatch):
    """The edges, of which there are many times the cells, are not shuffled again in each round."""
    plans, write = [], component_steps.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(component_steps, "materialise", seen)
    nodes = spark.createDataFrame([(i,) for i in range(30)], "cell long")
    edges = spark.createDataFrame([(i, i + 3) for i in range(24)], "a long, b long")
    expected = {(i, i if i > 26 else i % 3) for i in range(30)}
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        assert set(map(tuple, components(nodes, edges).collect())) == expected
        assert any("BroadcastHashJoin" in p for p in plans)
        # More cells than may be sent: by key.
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
        plans.clear()
        assert set(map(tuple, components(nodes, edges).collect())) == expected
        assert not any("BroadcastHashJoin" in p for p in plans)


def test_payload_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    """Pages are written compressed, a file holds few lines, and what is shuffled are the short catalogue rows."""
    monkeypatch.setattr(payloads, "FILE_PAGES", 7)
    rows = [
        (f"Shop {i % 60}" if i % 60 else None, str(i % 3000), f"u{i}", f"n{i}", None, "c", "m", "t", 1.0, 0.0, 4.0, 30, True, 5, 1, 1, "2025-01-01", source)
        for i in range(700) for source in ("shopify", "woocommerce")
    ]
    for source, payload in (("shopify", payloads.shop_payload), ("woocommerce", payloads.store_payload)):
        given = tmp_path / f"{source}.txt"
        given.write_text("given")
        made = payload(spark.createDataFrame(rows + rows[:40], PRODUCTS))
        path = payloads._landed_text(spark, f"packed-{source}", [str(given)], lambda: made)
        files = list(Path(path).glob("part-*"))
        assert all(f.name.endswith(".gz") and gzip.decompress(f.read_bytes()).count(b"\n") <= 7 for f in files)
        if source == "shopify":
            back = collect.shop_products(payloads.read_shop_pages(spark, path))
        else:
            back = payloads.read_store_pages(spark, path)
        got = Counter((r["shop_url"], r["id"]) for r in back.collect())
        assert got == Counter((r[0], int(r[1])) for r in rows + rows[:40] if r[-1] == source)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        shuffled = plan[plan.index("RepartitionByExpression") :]
        assert "collect_list" in plan and "named_struct" not in shuffled and "collect_list" not in shuffled


def test_normaliser(spark):
    rows = [
        ("Product A", "10.5", "shoes", "shopify", "001", "t", 0), ("Product B", "20", " Shoes ", "shopify", "002", "t", 1),
        ("Again", "1", None, "shopify", "001", "t", 2), (None, "1", None, "shopify", "3", "t", 3),
        ("Bad price", "-1", None, "shopify", "4", "t", 4), ("Other shop", "x", None, "shopify", "001", "u", 5),
        # The first of a pair is kept even when the quality filter then drops it.
        ("ab", "1", None, "shopify", "5", "t", 6), ("Long name", "1", None, "shopify", "5", "t", 7),
    ]
    df = spark.createDataFrame(rows, "nom string, prix string, categorie string, source string, product_id string, shop_url string, seq int")
    got = {(r["shop_url"], r["uid"], r["nom"], r["prix"], r["categorie"]) for r in normalise.normalise_products(df).collect()}
    assert got == {
        ("t", "shopify_001", "Product A", 10.5, "shoes"), ("t", "shopify_002", "Product B", 20.0, "shoes"),
        ("u", "shopify_001", "Other Shop", 0.0, "inconnu"),
    }


def test_csv_with_mark_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes('﻿uid,nom,prix\n1,"a ""quoted""\nname",2.5\n'.encode())
    row = tables.read_csv(spark, str(path), "uid string, nom string, prix double").collect()
    assert [tuple(r) for r in row] == [("1", 'a "quoted"\nname', 2.5)]


def test_first_existing_and_fallback(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b"))
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert tables.load_catalogue(spark, paths, lambda: spark.range(1)).count() == 3
    assert tables.load_catalogue(spark, paths[:1], lambda: generators.demo_catalogue(spark)).count() == 200


def test_generators(spark):
    df = generators.extended_catalogue(spark, 4000).cache()
    assert df.count() == 4000
    s = df.agg(
        F.min("rating"), F.max("rating"), F.max("stock"), F.expr("median(price)"), F.countDistinct("subcategory"),
        F.count_if(F.col("discount_pct") == 0), F.max("discount_pct"),
    ).first()
    assert s[0] >= 1 and s[1] <= 5 and s[2] <= 500 and 36 < s[3] < 44 and s[6] <= 51
    assert 0.45 < s[5] / 4000 < 0.55
    demo = generators.demo_catalogue(spark)
    assert demo.agg(F.avg(F.col("disponible").cast("int"))).first()[0] == pytest.approx(0.8, abs=0.1)


def test_cluster_names(spark):
    df = spark.createDataFrame(
        [(0, 4.5, 100.5, 0.0, 50.0), (1, 1.0, 31.0, 7.0, 20.5), (2, 4.0, 99.0, 501.0, 0.0), (3, 3.9, 29.5, 900.0, 20.0), (4, 4.4, 30.0, 500.0, 20.0)],
        "cluster_kmeans int, rating double, prix double, nb_reviews double, remise_pct double",
    )
    got = [r["segment"] for r in cluster.name_clusters(df).orderBy("cluster_kmeans").collect()]
    assert got == ["Premium populaire", "Produit en promo", "Bestseller", "Entrée de gamme", "Segment 4"]


def test_vocabulary_limit(spark):
    sets = {1: "abc", 2: "abd", 3: "ace", 4: "fgh"}
    df = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "basket int, item string")
    kept = {}
    for r in rules.limit_vocabulary(df, 3).collect():
        kept.setdefault(r["basket"], set()).add(r["item"])
    assert kept == {1: set("abc"), 2: set("ab"), 3: set("ac")}


@pytest.mark.parametrize("items", [5, 80])
def test_pair_counts_equal_brute_force(spark, items):
    rng = np.random.default_rng(1)
    sets = {b: set(rng.choice(70, rng.integers(2, 9), replace=False).tolist()) for b in range(120)}
    df = spark.createDataFrame([(b, f"i{v:02d}") for b, s in sets.items() for v in s], "basket int, item string")
    count = {}
    for s in sets.values():
        for v in s:
            count[v] = count.get(v, 0) + 1
    words = set(sorted(count, key=lambda v: (-count[v], v))[:items])
    expected, baskets = {}, 0
    for s in sets.values():
        k = sorted(s & words)
        if len(k) < 2:
            continue
        baskets += 1
        for i, a in enumerate(k):
            expected[(f"i{a:02d}", None)] = expected.get((f"i{a:02d}", None), 0) + 1
            for b in k[i + 1 :]:
                expected[(f"i{a:02d}", f"i{b:02d}")] = expected.get((f"i{a:02d}", f"i{b:02d}"), 0) + 1
    rows = rules.pair_counts(df, items).collect()
    assert {(r["a"], r["b"]): r["n"] for r in rows} == expected
    assert {r["baskets"] for r in rows} == {baskets}


def test_fallback_plans(spark):
    def shop(n_shops, brands=True):
        rows = [(f"s{i % n_shops}", f"m{i % 3}", f"cat{i % 4}", float(i)) for i in range(60)]
        df = spark.createDataFrame(rows, "shop_url string, marque string, categorie string, prix double")
        return df if brands else df.drop("marque")

    assert rules.choose_baskets(shop(6))[0] == "A" or rules.choose_baskets(shop(7))[0] == "A"
    assert rules.choose_baskets(shop(2))[0] == "C"  # three brands are too few as well
    assert rules.choose_baskets(shop(2, brands=False))[:2] == ("C", 5)
    none = shop(2).withColumn("prix", F.lit(0.0))
    assert rules.association_rules(none).count() == 0


def test_target_edge_cases(spark):
    df = spark.createDataFrame([(f"u{i}", float(i), -5.0, True, -1) for i in range(10)], "uid string, prix double, remise_pct double, disponible boolean, stock int")
    top = {r["uid"] for r in target.create_target(df).where("top_produit = 1").collect()}
    assert top == {"u0", "u1", "u2"}  # cheapest; negative discount and stock are left out
    scored, flat = target.target_score(df.withColumn("prix", F.lit(0.0)))
    assert flat and scored.agg(F.countDistinct("_target")).first()[0] == 10


def test_split_shares(spark):
    df = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("uid"), (F.col("id") % 10 < 3).cast("int").alias("top_produit"))
    n = {(r[0], r[1]): r[2] for r in target.stratified_split(df).groupBy("top_produit", "is_test").count().collect()}
    assert n == {(1, True): 60, (1, False): 240, (0, True): 140, (0, False): 560}
    folds = target.stratified_folds(df, "top_produit").groupBy("top_produit", "fold").count().collect()
    assert all(abs(r["count"] - (60 if r[0] else 140)) <= 1 for r in folds) and len(folds) == 10


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    report = {r["class"]: r for r in evaluate.class_report(evaluate.confusion(df)).collect()}
    assert (report[1]["precision"], report[1]["recall"], report[1]["f1"]) == (0.0, 0.0, 0.0)
    assert evaluate.accuracy_and_f1_values(df, "label", "prediction")[0] == pytest.approx(2 / 3)


def test_components_of_a_chain(spark):
    nodes = spark.range(40).withColumnRenamed("id", "cell")
    edges = spark.range(29).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    labels = {r["cell"]: r["label"] for r in components(nodes, edges).collect()}
    assert all(labels[i] == 0 for i in range(30)) and all(labels[i] == i for i in range(30, 40))


def test_score_without_model_and_top_k(spark):
    rows = [(f"u{i}", 5.0, 10, 1.0, True) for i in range(3)] + [("z", 1.0, 0, 0.1, False)]
    df = spark.createDataFrame(rows, "uid string, rating double, nb_reviews long, ratio_qualite_prix double, disponible boolean")
    scored = scoring.composite_score(df)
    got = [(r["uid"], r["score_composite"], r["rang"]) for r in scoring.filtered_top_k(scored, 3).collect()]
    assert got == [("u0", 75.0, 1), ("u1", 75.0, 1), ("u2", 75.0, 1)]
    assert scoring.filtered_top_k(df, 2).count() == 2


def test_questions_find_categories_anywhere(spark):
    from shelfwise.plans.prompts import enrich_questions

    rows = [("u1", "A", "bag", 10.0, 0.0), ("u2", "B", "Sac à dos", 20.0, 37.5), ("u3", "C", "sac", 30.0, 10.0)]
    df = spark.createDataFrame(rows, "uid string, nom string, categorie string, prix double, remise_pct double")
    asked = ["Un SAC À DOS en promo ?", "handbags", "budget", "", "rien"]
    questions = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    got = {r["qid"]: r["enriched"] for r in enrich_questions(questions, df).collect()}
    assert got[0] == (
        "Un SAC À DOS en promo ?\n[Données réelles pour 'Sac à dos': 1 produits, prix moyen 20€, remise moyenne 37.5%]"
        "\n[Top 3 remises: B (38%), C (10%)]"
    )
    assert "pour 'bag'" in got[1] and got[3] == "" and got[4] == "rien"
    assert got[2] == "budget\n[Produits les moins chers: A (10€), B (20€), C (30€)]"


def test_products_schema(spark, small):
    from shelfwise.sources.offers import products

    df = products(spark, small)
    assert df.schema == PRODUCTS
    assert df.count() == df.select("uid").distinct().count() == 1905
    assert not math.isnan(df.agg(F.max("prix")).first()[0])
