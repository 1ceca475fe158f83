"""Category association rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.quantiles import quantiles, scalars
from shelfwise.operators.sizing import materialise

# Texts that stand for no category.
UNKNOWN = "inconnu"
NO_CATEGORY = ("", "nan", "none")
# Markers a shop basket leaves out, and those brand and price baskets leave out.
SHOP_SKIPPED = ("inconnu", "nan", "none", "")
OTHER_SKIPPED = ("inconnu", "nan", "")
# Thresholds, vocabulary limit, basket counts of the fallback chain.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MAX_ITEMS = 0.02, 0.4, 1.1, 50
ENOUGH, TOO_FEW = 5, 3
QUINTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]

MASK_BITS = 62


def clean_category(category: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(category, F.lit(UNKNOWN))))
    return F.when(text.isin(*NO_CATEGORY), UNKNOWN).otherwise(text)


def baskets(df: DataFrame, group: str, skipped: tuple = SHOP_SKIPPED) -> DataFrame:
    """Distinct (basket, item) pairs of groups with at least two items, kept long."""
    pairs = (
        df.select(F.col(group).alias("basket"), clean_category(F.col("categorie")).alias("item"))
        .where(F.col("basket").isNotNull() & ~F.col("item").isin(*skipped))
        .distinct()
    )
    sizes = pairs.groupBy("basket").agg(F.count("*").alias("_n")).where("_n >= 2")
    return pairs.join(sizes, "basket", "left_semi")


def price_bins(df: DataFrame) -> DataFrame | None:
    """Rows with their price quintile, or None without usable prices."""
    if "prix" not in df.columns:
        return None
    if not scalars(df, s=F.sum("prix"))["s"]:
        return None
    cuts = quantiles(df, {"prix": QUINTILES})["prix"]
    edges = sorted(set(cuts.values()))
    price = F.col("prix")
    bin_ = F.when(price.isNull() | (price < F.lit(edges[0])), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        bin_ = bin_.when(price <= F.lit(upper), i)
    return df.withColumn("_bin", bin_)


def price_baskets(df: DataFrame) -> DataFrame:
    binned = price_bins(df)
    if binned is None:
        return baskets(df.withColumn("_bin", F.lit(None).cast("int")), "_bin", OTHER_SKIPPED)
    return baskets(binned, "_bin", OTHER_SKIPPED)


def basket_count(pairs: DataFrame) -> int:
    return scalars(pairs.select("basket").distinct(), n=F.count("*"))["n"]


def choose_baskets(df: DataFrame) -> tuple[str, int, DataFrame]:
    """Plan A by shop, else B by brand, else C by price quintile; the plan used and its size."""
    pairs = baskets(df, "shop_url")
    n = basket_count(pairs)
    plan = "A"
    if n < ENOUGH:
        plan, n = "B", 0
        if "marque" in df.columns:
            pairs = baskets(df, "marque", OTHER_SKIPPED)
            n = basket_count(pairs)
    if n < ENOUGH:
        plan, pairs = "C", price_baskets(df)
        n = basket_count(pairs)
    return plan, n, pairs


def vocabulary(pairs: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The most frequent items with their bit position; ties by item name."""
    counts = pairs.groupBy("item").agg(F.count("*").alias("n"))
    kept = counts.orderBy(F.desc("n"), "item").limit(max_items)
    listed = kept.agg(F.sort_array(F.collect_list("item")).alias("items"))
    return listed.select(F.posexplode("items").alias("code", "item"))


def limit_vocabulary(pairs: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Pairs of the kept items, in baskets that still hold two of them."""
    kept = pairs.join(F.broadcast(vocabulary(pairs, max_items).select("item")), "item", "left_semi")
    sizes = kept.groupBy("basket").agg(F.count("*").alias("_n")).where("_n >= 2")
    return kept.join(sizes, "basket", "left_semi").select("basket", "item")


def pair_counts(pairs: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """How many baskets hold each item and each pair: ``(a, b, n, baskets)``, b null for items.

    A basket becomes a bit mask of its kept items, so a basket of any size shrinks
    before the shuffle, equal baskets are counted once, and pairs are summed as
    columns of a 50-by-50 table. No pair is ever emitted per basket.
    """
    words = materialise(vocabulary(pairs, max_items))
    n_masks = -(-max_items // MASK_BITS)
    position = (F.col("code") % MASK_BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), position)
    coded = pairs.join(F.broadcast(words), "item")
    masks = [f"m{i}" for i in range(n_masks)]
    per_basket = coded.groupBy("basket").agg(
        *[
            F.bit_or(
                F.when(F.floor(F.col("code") / MASK_BITS) == i, bit).otherwise(F.lit(0).cast("long"))
            ).alias(m)
            for i, m in enumerate(masks)
        ]
    )
    size = sum((F.bit_count(m) for m in masks[1:]), F.bit_count(masks[0]))
    shapes = materialise(per_basket.where(size >= 2).groupBy(*masks).agg(F.count("*").alias("n")))

    # Long lists of like expressions, as SQL text.
    codes = range(max_items)
    holds = [f"getbit({masks[c // MASK_BITS]}, {c % MASK_BITS})" for c in codes]
    # One row per item of a shape (its size, not its square), summed against 50 columns.
    present = ", ".join(f"if({holds[c]} = 1, {c}, null)" for c in codes)
    opened = shapes.select("n", *masks, F.expr(f"explode(array_compact(array({present})))").alias("a"))
    table = opened.groupBy("a").agg(*[F.expr(f"sum({holds[c]} * n) AS c{c}") for c in codes])
    cells = ", ".join(f"struct({c} AS b, c{c} AS n)" for c in codes)
    long = table.select("a", F.expr(f"inline(array({cells}))")).where("n > 0 AND a <= b")
    names = words.select(F.col("code").alias("a"), F.col("item").alias("item_a"))
    others = words.select(F.col("code").alias("b"), F.col("item").alias("item_b"))
    total = scalars(shapes, n=F.coalesce(F.sum("n"), F.lit(0)))["n"]
    named = long.join(F.broadcast(names), "a").join(F.broadcast(others), "b")
    return named.select(
        F.col("item_a").alias("a"),
        F.when(F.col("a") != F.col("b"), F.col("item_b")).alias("b"),
        "n",
        F.lit(total).cast("long").alias("baskets"),
    )


def frequent_sets(counts: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Items and pairs at or above the support."""
    support = F.col("n") / F.col("baskets")
    return counts.withColumn("support", support).where(F.col("support") >= min_support)


def support_ladder(counts: DataFrame, min_support: float = MIN_SUPPORT, top: float = 0.5) -> DataFrame:
    """Frequent sets per support tried: from the minimum, half more each time, up to ``top``."""
    steps, support = [], min_support
    while support <= top:
        steps.append(support)
        support = round(support * 1.5, 3)
    share = F.col("n") / F.col("baskets")
    totals = counts.agg(
        *[F.count_if(share >= s).alias(f"k{i}") for i, s in enumerate(steps)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("attempt"), F.lit(s).alias("min_support"), F.col(f"k{i}").alias("n_sets")
            )
            for i, s in enumerate(steps)
        ]
    )
    return totals.select(F.inline(rows))


def adaptive_support(counts: DataFrame, min_support: float = MIN_SUPPORT, top: float = 0.5) -> float:
    """First support of the ladder with any set; the last one tried when there is none."""
    hit = support_ladder(counts, min_support, top).where("n_sets > 0").orderBy("attempt").first()
    return hit["min_support"] if hit else min_support


def rules_from_counts(
    counts: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """One-to-one rules with their measures, best lift first."""
    sets = frequent_sets(counts, min_support)
    items = F.broadcast(sets.where(F.col("b").isNull()).select("a", F.col("support").alias("s")))
    pairs = sets.where(F.col("b").isNotNull())
    both = pairs.select(
        F.col("support"),
        F.explode(
            F.array(
                F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent")),
                F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent")),
            )
        ).alias("r"),
    ).select("r.*", "support")
    left = items.select(F.col("a").alias("antecedent"), F.col("s").alias("antecedent_support"))
    right = items.select(F.col("a").alias("consequent"), F.col("s").alias("consequent_support"))
    joined = both.join(F.broadcast(left), "antecedent").join(F.broadcast(right), "consequent")
    sa, sc, s = F.col("antecedent_support"), F.col("consequent_support"), F.col("support")
    confidence = s / sa
    spread = F.greatest(s * (F.lit(1.0) - sa), sa * (sc - s))
    measured = joined.withColumns(
        {
            "confidence": confidence,
            "lift": confidence / sc,
            "leverage": s - sa * sc,
            "conviction": F.when(confidence >= 1.0, F.lit(float("inf"))).otherwise(
                (F.lit(1.0) - sc) / F.nullif(F.lit(1.0) - confidence, F.lit(0.0))
            ),
            "zhangs_metric": F.coalesce(
                (s - sa * sc) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)
            ),
        }
    )
    return measured.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).orderBy(
        F.desc("lift"), "antecedent", "consequent"
    )


def top_rules(rules: DataFrame, k: int = 10) -> DataFrame:
    """Display form: best rules with three decimals."""
    best = rules.orderBy(F.desc("lift"), "antecedent", "consequent").limit(k)
    return best.select(
        "antecedent", "consequent",
        *[F.round(c, 3).alias(c) for c in ("support", "confidence", "lift")],
    )


RULE_COLUMNS = (
    "antecedent string, consequent string, support double, antecedent_support double, "
    "consequent_support double, confidence double, lift double, leverage double, "
    "conviction double, zhangs_metric double"
)


def association_rules(
    df: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    max_items: int = MAX_ITEMS,
    adaptive: bool = False,
) -> DataFrame:
    """The whole chain on a catalogue; empty when there are too few baskets."""
    _, n, pairs = choose_baskets(df)
    if n < TOO_FEW:
        return df.sparkSession.createDataFrame([], RULE_COLUMNS)
    counts = materialise(pair_counts(pairs, max_items))
    if adaptive:
        min_support = adaptive_support(counts, min_support)
    return rules_from_counts(counts, min_support, min_confidence, min_lift)
