"""Facts put into prompts, and the prompt texts; no model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import fixed
from shelfwise.operators.quantiles import quantiles, scalars
from shelfwise.operators.ranking import top_k, top_per_group
from shelfwise.operators.sizing import lookup_side

# List lengths and text lengths of the facts.
TOP_CATEGORIES, TOP_PRODUCTS, NAME_CHARS = 5, 10, 40
SUMMARY_MIN_CHARS, SUMMARY_MAX_CHARS = 20, 800
CHAT_CATEGORIES, CHAT_TOP = 15, 5
# Words that ask for promotions, and for low prices.
PROMO_WORDS = ("promo", "remise", "réduction", "solde")
CHEAP_WORDS = ("moins cher", "pas cher", "économique", "budget")


def _score(df: DataFrame) -> str:
    return "score_composite" if "score_composite" in df.columns else "prix"


def _lines(df: DataFrame, order: str, line: str = "line", sep: str = "\n") -> Column:
    """One text of a short table's lines in order."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line]), sep
    )


def catalogue_context(df: DataFrame) -> DataFrame:
    """Overall figures as text with fixed decimals, one row."""
    median = quantiles(df, {"prix": [0.5]})["prix"][0.5]
    promo = F.col("remise_pct") > 0
    shops = F.countDistinct("shop_url") if "shop_url" in df.columns else F.lit(1).cast("long")
    discount = F.avg(F.when(promo, F.col("remise_pct")))
    return df.agg(
        F.count("*").alias("nb_produits"),
        shops.alias("nb_shops"),
        F.countDistinct("categorie").alias("nb_categories"),
        fixed(F.avg("prix"), 2).alias("prix_moyen"),
        fixed(F.min("prix"), 2).alias("prix_min"),
        fixed(F.max("prix"), 2).alias("prix_max"),
        fixed(F.count_if(promo) / F.count("*") * 100, 1).alias("pct_promo"),
        F.when(F.count_if(promo) > 0, fixed(discount, 1)).otherwise("0").alias("remise_moyenne"),
    ).withColumn("prix_median", fixed(F.lit(median).cast("double"), 2))


def top_categories(df: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    counts = df.where(F.col("categorie").isNotNull()).groupBy("categorie").agg(F.count("nom").alias("n"))
    return counts.orderBy(F.desc("n"), "categorie").limit(k)


def top_products(df: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    """Best products with their rendered line."""
    score = _score(df)
    line = F.concat(
        F.lit("  - "), F.substring("nom", 1, NAME_CHARS), F.lit(" ("), F.col("categorie"),
        F.lit(") — "), fixed(F.col("prix"), 0), F.lit("€ — score: "), fixed(F.col(score), 2),
    )
    best = top_k(df, k, score)
    place = Window.orderBy(F.desc(score), "uid")
    return best.select("uid", F.row_number().over(place).alias("position"), line.alias("line"))


def segment_lines(df: DataFrame) -> DataFrame:
    """Segments by size with their rendered line."""
    total = max(scalars(df, n=F.count("*"))["n"], 1)
    counts = df.where(F.col("segment").isNotNull()).groupBy("segment").agg(F.count("*").alias("n"))
    share = fixed(F.col("n") / F.lit(float(total)) * 100, 1)
    line = F.concat(
        F.lit("  - "), "segment", F.lit(": "), F.col("n").cast("string"), F.lit(" produits ("),
        share, F.lit("%)"),
    )
    return counts.select("segment", "n", line.alias("line"))


def trend_context(df: DataFrame) -> DataFrame:
    """All facts of the trend report in one row; the lists are a few lines each."""
    categories = top_categories(df).select(
        F.struct((-F.col("n")).alias("o"), "categorie").alias("o"),
        F.concat(
            F.lit("  - "), "categorie", F.lit(" : "), F.col("n").cast("string"), F.lit(" produits")
        ).alias("line"),
    )
    texts = {
        "top_categories": scalars(categories, t=_lines(categories, "o"))["t"],
        "top_produits": scalars(top_products(df), t=_lines(df, "position"))["t"],
        "segments": "Non disponible",
    }
    if "segment" in df.columns:
        ordered = segment_lines(df).select(
            F.struct((-F.col("n")).alias("o"), "segment").alias("o"), "line"
        )
        texts["segments"] = scalars(ordered, t=_lines(ordered, "o"))["t"]
    return catalogue_context(df).withColumns({k: F.lit(v) for k, v in texts.items()})


def segment_profiles(df: DataFrame, k: int = 5) -> DataFrame:
    """Per segment its means and its best products, one scan for all segments."""
    best = top_per_group(df, "segment", k, [F.desc("score_composite"), F.asc("uid")], "position")
    line = F.concat(
        F.lit("  - "), F.substring("nom", 1, NAME_CHARS), F.lit(" — "), fixed(F.col("prix"), 0), F.lit("€")
    )
    listed = best.select("segment", "position", line.alias("line"))
    products = listed.groupBy("segment").agg(_lines(listed, "position").alias("produits"))
    means = df.groupBy("segment").agg(
        fixed(F.avg("prix"), 2).alias("prix_moyen"),
        fixed(F.avg("remise_pct"), 1).alias("remise_moyenne"),
        fixed(F.avg("score_composite"), 2).alias("score_moyen"),
    )
    return means.join(products, "segment")


def summary_candidates(df: DataFrame, n: int = 50) -> DataFrame:
    """Best products that have a description worth a summary."""
    described = df.where(F.length("description") > SUMMARY_MIN_CHARS)
    best = top_k(described, n, "score_composite") if "score_composite" in df.columns else described.orderBy("uid").limit(n)
    return best.select(
        "uid",
        F.coalesce("nom", F.lit("Produit inconnu")).alias("nom"),
        F.coalesce("categorie", F.lit("N/A")).alias("categorie"),
        fixed(F.coalesce("prix", F.lit(0.0)), 2).alias("prix"),
        F.substring("description", 1, SUMMARY_MAX_CHARS).alias("description"),
    )


def marketing_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """Best products as text fields."""
    zero = F.lit(0.0)
    return top_k(df, n, _score(df)).select(
        "uid",
        F.substring(F.coalesce("nom", F.lit("Produit")), 1, 60).alias("nom"),
        F.coalesce("categorie", F.lit("N/A")).alias("categorie"),
        F.coalesce("shop_url", F.lit("N/A")).alias("shop_url"),
        fixed(F.coalesce("prix", zero), 2).alias("prix"),
        fixed(F.coalesce("remise_pct", zero), 1).alias("remise_pct"),
        fixed(F.coalesce("score_composite", zero), 2).alias("score_composite"),
        F.coalesce("segment", F.lit("N/A")).alias("segment"),
        F.coalesce("stock", F.lit(0)).cast("long").cast("string").alias("stock"),
        F.when(F.col("en_promo") == 1, "Oui").otherwise("Non").alias("en_promo"),
    )


def chat_context(df: DataFrame) -> DataFrame:
    """Facts of the assistant, one row; categories in sorted order."""
    score = _score(df)
    cats = df.select("categorie").where(F.col("categorie").isNotNull()).distinct()
    first = cats.orderBy("categorie").limit(CHAT_CATEGORIES + 1)
    names = scalars(first, c=F.sort_array(F.collect_list("categorie")))["c"]
    listed = ", ".join(names[:CHAT_CATEGORIES]) + ("..." if len(names) > CHAT_CATEGORIES else "")
    kinds = df.select("source").where(F.col("source").isNotNull()).distinct()
    sources = scalars(kinds, s=F.array_join(F.sort_array(F.collect_list("source")), ", "))["s"]
    best = top_k(df, CHAT_TOP, score)
    place = F.row_number().over(Window.orderBy(F.desc(score), "uid"))
    line = F.concat(
        F.lit("  "), F.col("position").cast("string"), F.lit(". "), F.substring("nom", 1, NAME_CHARS),
        F.lit(" — "), fixed(F.col("prix"), 0), F.lit("€ — score: "), fixed(F.col(score), 2),
    )
    lines = best.withColumn("position", place).select("position", line.alias("line"))
    top5 = scalars(lines, t=_lines(lines, "position"))["t"]
    promo = F.col("remise_pct") > 0
    return df.agg(
        F.count("*").alias("nb_produits"),
        fixed(F.min("prix"), 2).alias("prix_min"),
        fixed(F.max("prix"), 2).alias("prix_max"),
        fixed(F.count_if(promo) / F.count("*") * 100, 1).alias("pct_promo"),
        fixed(F.avg(score), 2).alias("score_moyen"),
    ).withColumns({"sources": F.lit(sources), "categories": F.lit(listed), "top5": F.lit(top5)})


def _pieces(text: Column, lengths: list[int]) -> Column:
    """Distinct pieces of a text in the given lengths, at every position."""
    size = F.length(text)

    def of_length(wanted: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - wanted + 1, F.lit(1)))
        return F.transform(starts, lambda at: F.substr(text, at, wanted))

    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= size)
    return F.array_distinct(F.flatten(F.transform(fitting, of_length)))


def enrich_questions(questions: DataFrame, df: DataFrame, key: str = "qid", text: str = "question") -> DataFrame:
    """Append real figures to each question: its category, promotions, low prices.

    A category occurs in a question when it equals one of its pieces, so questions meet
    categories by key: a question gives its pieces in the lengths category names have,
    and a piece meets one name at most. The first matching category in sorted order
    counts.
    """
    stats = df.where(F.col("categorie").isNotNull()).groupBy("categorie").agg(
        F.count("*").alias("n"), F.avg("prix").alias("px"), F.avg("remise_pct").alias("rem")
    )
    stats = lookup_side(stats.withColumn("piece", F.lower("categorie")))
    lengths = scalars(stats, n=F.sort_array(F.collect_set(F.length("piece"))))["n"]
    asked = questions.withColumn("_q", F.lower(text))
    if lengths:
        pieces = asked.select(key, F.explode(_pieces(F.col("_q"), lengths)).alias("piece"))
        met = pieces.join(stats, "piece")
    else:
        met = asked.select(key, F.lit("").alias("piece")).join(stats, "piece")
    hits = met.groupBy(key).agg(F.min(F.struct("categorie", "n", "px", "rem")).alias("c"))
    # The wording of the facts, part of the result.
    fact = F.concat(
        F.lit("\n[Données réelles pour '"), F.col("c.categorie"), F.lit("': "),
        F.col("c.n").cast("string"), F.lit(" produits, prix moyen "), fixed(F.col("c.px"), 0),
        F.lit("€, remise moyenne "), fixed(F.col("c.rem"), 1), F.lit("%]"),
    )

    def named(rows: DataFrame, order: Column, shown: Column) -> str | None:
        listed = rows.select(F.struct(order.alias("o"), "uid").alias("o"), shown.alias("line"))
        return scalars(listed, t=_lines(listed, "o", sep=", "))["t"]

    name = F.substring("nom", 1, 25)
    promos = top_k(df.where(F.col("remise_pct") > 0), 3, "remise_pct")
    best = named(promos, -F.col("remise_pct"), F.concat(name, F.lit(" ("), fixed(F.col("remise_pct"), 0), F.lit("%)")))
    cheap = named(
        top_k(df, 3, "prix", ascending=True), F.col("prix"),
        F.concat(name, F.lit(" ("), fixed(F.col("prix"), 0), F.lit("€)")),
    )

    def mentions(words: tuple) -> Column:
        found = F.contains("_q", F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains("_q", F.lit(word))
        return found

    # The wording of the two lists, part of the result.
    promo_text = f"\n[Top 3 remises: {best}]" if best else ""
    cheap_text = f"\n[Produits les moins chers: {cheap}]" if cheap else ""
    return (
        asked.join(hits, key, "left")
        .select(
            key,
            F.concat(
                F.col(text),
                F.coalesce(fact, F.lit("")),
                F.when(mentions(PROMO_WORDS), promo_text).otherwise(""),
                F.when(mentions(CHEAP_WORDS), cheap_text).otherwise(""),
            ).alias("enriched"),
        )
    )


def sliding_memory(turns: DataFrame, max_history: int = 6) -> DataFrame:
    """The last exchanges of each conversation: twice ``max_history`` messages."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= 2 * max_history)
    return kept.drop("_age")


# Questions suggested to a user; the third names a category.
SUGGESTIONS = (
    "Quels sont les 5 meilleurs produits du dataset ?",
    "Quelles sont les tendances principales détectées ?",
    "Analyse la catégorie '{}'",
    "Quels produits sont en promotion en ce moment ?",
    "Quelle stratégie marketing recommandes-tu pour les top produits ?",
    "Quels produits ont le meilleur rapport qualité/prix ?",
)


def suggested_questions(df: DataFrame) -> DataFrame:
    """Suggestions; without any category the one about a category is left out."""
    first = scalars(df, c=F.min("categorie"))["c"]
    texts = [t.format(first) for t in SUGGESTIONS if "{}" not in t or first is not None]
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(t).alias("question")) for i, t in enumerate(texts)]
    )
    return df.sparkSession.range(1).select(F.inline(rows))


# Our own wording of the five prompts; ``{name}`` marks a fact. Callers may pass others.
TEMPLATES = {
    "resume": (
        "Rédige un court résumé commercial.\nProduit : {nom}\nCatégorie : {categorie}\n"
        "Prix : {prix}€\nDescription : {description}"
    ),
    "tendances": (
        "Rédige un rapport de tendances.\n{nb_produits} produits, {nb_shops} boutiques, "
        "{nb_categories} catégories\nPrix {prix_min}€ à {prix_max}€, moyen {prix_moyen}€, "
        "médian {prix_median}€\nPromotions {pct_promo}%, remise {remise_moyenne}%\n"
        "Catégories :\n{top_categories}\nProduits :\n{top_produits}\nSegments :\n{segments}"
    ),
    "marketing": (
        "Propose un plan marketing.\n{nom} ({categorie}) chez {shop_url}\n{prix}€, remise "
        "{remise_pct}%\nScore {score_composite}, segment {segment}\nStock {stock}, promo {en_promo}"
    ),
    "assistant": (
        "Réponds à partir de ces faits.\n{nb_produits} produits, sources {sources}\n"
        "Catégories : {categories}\nPrix {prix_min}€ à {prix_max}€, promotions {pct_promo}%, "
        "score moyen {score_moyen}\n{top5}"
    ),
    "profil": (
        "Décris le client type.\nSegment {segment} : prix {prix_moyen}€, remise "
        "{remise_moyenne}%, score {score_moyen}\n{produits}"
    ),
}


def render(facts: DataFrame, kind: str, key: str | None = None, template: str | None = None) -> DataFrame:
    """Fill a template from a table of facts: ``(prompt_id, kind, text)``."""
    template = template if template is not None else TEMPLATES[kind]
    pieces: list[Column] = []
    for i, piece in enumerate(template.split("{")):
        if i == 0:
            pieces.append(F.lit(piece))
            continue
        name, _, tail = piece.partition("}")
        pieces += [F.coalesce(F.col(name).cast("string"), F.lit("N/A")), F.lit(tail)]
    ident = F.col(key).cast("string") if key else F.lit(kind)
    return facts.select(ident.alias("prompt_id"), F.lit(kind).alias("kind"), F.concat(*pieces).alias("text"))


def all_prompts(df: DataFrame, n_summaries: int = 30, n_marketing: int = 10) -> DataFrame:
    """Every prompt of a run in one table."""
    return (
        render(summary_candidates(df, n_summaries), "resume", "uid")
        .unionByName(render(trend_context(df), "tendances"))
        .unionByName(render(marketing_rows(df, n_marketing), "marketing", "uid"))
        .unionByName(render(chat_context(df), "assistant"))
        .unionByName(render(segment_profiles(df), "profil", "segment"))
    )


def attach_texts(df: DataFrame, texts: DataFrame, out: str = "description_llm") -> DataFrame:
    """Left-attach generated texts ``(uid, text)``; products without one get ``""``.

    The texts cover a chosen top n, so their side is small; it is counted before it
    is broadcast.
    """
    side = lookup_side(texts.select("uid", F.trim("text").alias(out)))
    return df.join(side, "uid", "left").withColumn(out, F.coalesce(out, F.lit("")))


def filled_count(df: DataFrame, column: str = "description_llm") -> DataFrame:
    return df.agg(F.count_if(F.col(column) != "").alias("n_done"), F.count("*").alias("n"))
