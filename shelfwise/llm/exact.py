"""Exact deduplication with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import OWN, TAG, release, stage, tagged, text_or_empty

RESULT = {f"{OWN}keep_id": "keep_id", f"{OWN}size": "group_size", f"{OWN}kept": "kept", f"{OWN}sha": "text_sha256"}


def exact_groups(docs: DataFrame, *, keep: list[str] | None = None, **how) -> DataFrame:
    """``keep`` and ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row; see ``placed_copies``.

    A column of the input that has the name of a result column gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.values()]
    return placed_copies(docs, keep=names, **how).select(*names, *[F.col(a).alias(b) for a, b in RESULT.items()])


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows that stay, with exactly the columns of ``docs``."""
    return placed_copies(docs, **how).where(f"{OWN}kept").select(*docs.columns)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def placed_copies(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    salts: int = 16,
    ways: int = 64,
    keep: list[str] | None = None,
    digest: Callable[[Column], Column] = sha256,
    match_text: bool = False,
) -> DataFrame:
    """Group of equal texts of every row: the id that stays, the size, the kept mark, the SHA-256.

    Copies are combined in three steps, each of which compares digest and whole text:
    inside a task (the partial aggregate), then among the rows of a digest that share a
    salt, then among the salts' winners. A group that holds a third of all rows is so
    reduced to one row a task before any shuffle and to ``salts`` rows before the last.
    Rows find their group by digest; only if some digest stands for several texts, or with
    ``match_text``, by digest and whole text. The way back is salted too: the rows of a group
    lie in up to ``ways`` parts, each part gives its last row, the last of these stays, and
    every part meets a copy of the group's row. No task holds more than a part of a group.

    Null text counts as empty; empty texts are a group like any other. The row with the
    largest id stays; a null id stays only if its group has no other. Of rows that repeat
    the kept id one stays. An empty table gives an empty result.
    """
    keep = list(docs.columns if keep is None else keep)
    own_text, own_id, own_digest = F.col(f"{OWN}text"), F.col(f"{OWN}id"), F.col(f"{OWN}digest")
    wanted = docs.select(*keep, text_or_empty(text).alias(f"{OWN}text"), F.col(doc_id).cast("long").alias(f"{OWN}id"))
    rows = tagged(wanted.withColumn(f"{OWN}digest", digest(own_text)))
    if digest is not sha256:
        rows = rows.withColumn(f"{OWN}sha", sha256(own_text))
    way = F.pmod(F.xxhash64(own_id, TAG), F.lit(ways)).cast("int").alias(f"{OWN}way")
    stored = stage((rows if match_text else rows.drop(f"{OWN}text")).select("*", way), "exact-rows")
    salted = (
        rows.withColumn(f"{OWN}salt", F.pmod(F.xxhash64(own_id), F.lit(salts)))
        .groupBy(own_digest, own_text, f"{OWN}salt")
        .agg(F.max(own_id).alias("most"), F.count("*").alias("n"))
    )
    groups = salted.groupBy(own_digest, own_text).agg(
        F.max("most").alias(f"{OWN}keep_id"), F.sum("n").alias(f"{OWN}size")
    )
    sizes = stage(groups if match_text else groups.drop(f"{OWN}text"), "exact-groups")
    by = [f"{OWN}digest"] + [f"{OWN}text"] * match_text
    if not match_text and not sizes.groupBy(own_digest).count().where("count > 1").isEmpty():
        release(stored)
        release(sizes)
        return placed_copies(
            docs, text=text, doc_id=doc_id, salts=salts, ways=ways, keep=keep, digest=digest, match_text=True
        )
    last = F.max(F.struct(own_id.alias("id"), F.col(TAG).alias("tag"))).alias("last")
    parts = stage(stored.groupBy(*by, f"{OWN}way").agg(last), "exact-parts")
    winners = parts.groupBy(*by).agg(F.max("last").getField("tag").alias(f"{OWN}kept_tag"))
    places = parts.drop("last").join(sizes.join(winners, by), by)
    sha = F.col(f"{OWN}digest" if digest is sha256 else f"{OWN}sha")
    return stored.join(places, [*by, f"{OWN}way"]).select(
        *keep,
        f"{OWN}keep_id",
        f"{OWN}size",
        (F.col(TAG) == F.col(f"{OWN}kept_tag")).alias(f"{OWN}kept"),
        sha.alias(f"{OWN}sha"),
    )
