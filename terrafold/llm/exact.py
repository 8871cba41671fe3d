"""Exact de-duplication by 128-bit content hash, with the bytes compared inside each hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import WHITE, hash128, whole_text


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], list[Column]] = hash128) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per row of ``docs``.

    Texts are equal when identical after each run of white space became one space; null counts as empty.
    Grouping is by (hash, text): rows are dealt by the hash and the engine compares the bytes of each hash, so
    texts whose hashes collide are separate classes. Copies collapse before the shuffle. Documents then find
    their class by (hash, sha256) with slim rows; a large group of copies is many slim rows against one.

    The smallest doc_id stays. Rows that repeat both id and text count in ``group_size`` and are each ``kept``.
    A null doc_id never wins against an id; a class of null ids only has a null ``keep_id`` and is kept.
    """
    text = F.regexp_replace(whole_text(), f"{WHITE}+", " ")
    normal = docs.select(F.col("doc_id").alias("id"), text.alias("normal"))
    rows = normal.select("id", "normal", *content_hash(F.col("normal")))
    sha = F.sha2(F.col("normal"), 256)
    classes = (
        rows.groupBy("h1", "h2", "normal")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h1", "h2", sha.alias("text_sha256"), "keep_id", "group_size")
    )
    slim = rows.select("id", "h1", "h2", sha.alias("text_sha256"))
    return slim.join(classes, ["h1", "h2", "text_sha256"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
