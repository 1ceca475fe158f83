"""Spelling variants: words one edit apart by pivotal bigrams, and the form each one goes back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from shelfwise.llm.common import OWN, arrow_type, release, shuffle_width, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: Distinct words that a task counts before it hands their counts on.
TABLE = 200_000


def slipped(doc_id, run: str, slip: int) -> str:
    """The run as the document spells it: in one of ``slip`` a letter chosen by the same code is missing."""
    code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if code % slip:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, text: str, doc_id: str, shortest: int, spell: Callable[[object, str], str] | None
) -> DataFrame:
    """``(word, n)`` over all runs of letters: lower-cased in A to Z, then spelled by ``spell``, which goes by document and run.

    Every task adds up the words of its documents before the shuffle, so a common word is a
    row a task at most every ``TABLE`` words.
    """
    schema = StructType([StructField("word", StringType(), False), StructField("n", LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, value in enumerate(texts):
                for run, n in Counter(RUN.findall((value.as_py() or "").translate(LOWER))).items():
                    word = spell(ids[i], run) if spell else run
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) >= TABLE:
                    yield made()
                    counts.clear()
        if counts:
            yield made()

    rows = docs.select(F.col(doc_id).alias(f"{OWN}id"), F.col(text).alias(f"{OWN}text")).mapInArrow(count, schema)
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def bigram_ranks(words: DataFrame) -> tuple[dict[str, int], list[int]]:
    """Place of every bigram in the order from rare to common, ties by code point, and how often each place's occurs.

    Words hold 90 letters at most (a-z and 64 from U+00C0 on), so this has at most 8,100 entries.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    grams = words.select("word", at).select(F.expr("substring(word, at, 2)").alias("gram"))
    seen = grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").collect()
    return {r["gram"]: place for place, r in enumerate(seen)}, [r["n"] for r in seen]


def gram_prefix(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """``(rank, position)`` of the rarest bigrams: three, and all that are equal to the third.

    One edit touches two bigrams that overlap, so of any two disjoint ones the edit leaves
    one; of three bigrams two are disjoint.
    """
    placed = sorted((ranks[g], i) for i, g in enumerate(bigrams(word)))
    return [p for p in placed if p[0] <= placed[min(2, len(placed) - 1)][0]]


def pivots(prefix: list[tuple[int, int]], frequency: Callable[[int], float], wanted: int = 2) -> list[tuple[int, int]]:
    """``wanted`` disjoint bigrams of a prefix with the least summed frequency, by dynamic programming.

    By position, the best choice of k among the bigrams up to one either leaves it out or
    adds it to the best choice of k - 1 among those that end before it.
    """
    order = sorted(prefix, key=lambda p: p[1])
    never = (float("inf"), [])
    best = [[(0.0, [])] * (len(order) + 1)] + [[never] * (len(order) + 1) for _ in range(wanted)]
    for k in range(1, wanted + 1):
        for i, (rank, at) in enumerate(order, 1):
            before = i - 1
            while before and order[before - 1][1] > at - 2:
                before -= 1
            cost, chosen = best[k - 1][before]
            with_it = (cost + frequency(rank), [*chosen, (rank, at)])
            best[k][i] = min(best[k][i - 1], with_it, key=lambda c: c[0])
    return best[wanted][-1][1]


def _signatures(words: DataFrame, ranks: dict[str, int], seen: list[int]) -> DataFrame:
    """Each word with its length, letter set, prefix, pivots and the rank of its prefix's last bigram."""
    pair = StructType([StructField("gram", IntegerType(), False), StructField("at", IntegerType(), False)])
    extra = [
        StructField("size", IntegerType(), False), StructField("letters", LongType(), False),
        StructField("last", IntegerType(), False),
        StructField("prefix", ArrayType(pair, False), False), StructField("pivots", ArrayType(pair, False), False),
    ]
    kinds = [arrow_type(f.dataType) for f in extra]
    schema = StructType([words.schema["word"], words.schema["n"], *extra])
    # Letters fall into 58 classes; those that share a class only weaken the filter.
    bit = {chr(c): (c - 97 if c < 123 else 26 + (c - 0xC0) % 32) for c in [*range(97, 123), *range(0xC0, 0x100)]}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                prefix = gram_prefix(word, ranks)
                letters = sum(1 << b for b in {bit.get(c, 58) for c in word})
                chosen = pivots(prefix, seen.__getitem__)
                as_pairs = [[{"gram": g, "at": i} for g, i in some] for some in (prefix, chosen)]
                rows.append((len(word), letters, prefix[-1][0], *as_pairs))
            columns = list(zip(*rows)) if rows else [()] * len(extra)
            arrays = [*batch.columns[:2], *(pa.array(c, type=k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return words.select("word", "n").mapInArrow(sign, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of distinct words one insertion, deletion or replacement apart: ``(a, b)``, both ways round.

    Of two near words, the one whose prefix ends no later in the order of bigrams has a pivot
    that the edit leaves, and the other's prefix holds it: the edit touches one of two disjoint
    pivots, and what is no more common than a prefix's last bigram lies in the prefix. Pivots
    meet prefixes on bigram, length and position: equal lengths at the same position, and
    lengths one apart at the same position or moved by that one. What meets is compared by
    its letters, then by its distance.

    A common bigram is a skewed join key, which Spark may split; pairs that meet are compared
    as the join makes them and only near ones are kept.
    """
    signed = stage(_signatures(words, *bigram_ranks(words)).repartition(shuffle_width(words.sparkSession), "word"), "spelling-signs")
    key = ["gram", "at", "size"]
    held = signed.select("word", "size", "letters", "last", F.explode("prefix").alias("p")).select(
        F.col("word").alias("b"), "size", F.col("letters").alias("b_letters"), F.col("last").alias("b_last"), "p.gram", "p.at"
    )
    moves = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    probes = signed.select("word", "size", "letters", "last", F.explode("pivots").alias("p"))
    probes = probes.select("*", F.explode(moves).alias("move")).select(
        F.col("word").alias("a"), (F.col("size") + F.col("move.s")).alias("size"), F.col("letters").alias("a_letters"),
        F.col("last").alias("a_last"), F.col("p.gram").alias("gram"), (F.col("p.at") + F.col("move.m")).alias("at"),
    )
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2
    met = probes.join(held, key).where((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & alike)
    near = met.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    once = stage(near.distinct(), "spelling-pairs")
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both._staged_path = once._staged_path
    release(signed)
    return both


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of all words that have a form, by pointer jumping.

    ``forms`` is ``(word, form)``; a form is several times as common as its word, so forms
    have no circles, and each round halves what is left of a chain.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(
            now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        release(now)
        if after.where("moved").isEmpty():
            return after
        now = after.drop("moved")
        now._staged_path = after._staged_path


def variants(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shortest: int = 6, least: int = 5, ratio: int = 5,
    spell: Callable[[object, str], str] | None = None,
) -> DataFrame:
    """Words of at least ``shortest`` letters and ``least`` occurrences, with their form and root.

    Two words are near if one inserted, deleted or replaced letter parts them. The form is the
    most common near word (ties: least in code-point order) if it is at least ``ratio`` times as
    common; the root is where forms lead. Words without near words have ``n_near`` 0, without a
    form themselves as root.

    Whole texts count; null and empty texts hold no words, a null id spells like an empty one,
    repeated rows count as often as they stand, an empty table gives no words, other columns
    are not looked at. ``shortest`` must be 4 or more, as shorter words may lack two disjoint
    bigrams among three.
    """
    if shortest < 4:
        raise ValueError("words need four letters for two disjoint bigrams")
    counted = word_counts(docs, text, doc_id, shortest, spell)
    words = stage(counted.where(F.col("n") >= least), "spelling-words")
    pairs = near_pairs(words)
    common = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = pairs.join(common, "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), "b")).alias("best")
    )
    near = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("near"), (-F.col("best.minus")).alias("near_n"))
    enough: Column = F.col("near_n") >= ratio * F.col("n")
    with_form = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    found = roots(with_form.where("form IS NOT NULL").select("word", "form"))
    out = stage(
        with_form.join(found.select("word", "root"), "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
        ),
        "spelling-result",
    )
    for t in (words, pairs, with_form, found):
        release(t)
    return out
