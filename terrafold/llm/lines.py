"""Line de-duplication: lines that several documents share stay in the smallest document only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import ascii_lower, carried, hash128, order_id, uncarried, whole_text

MIN_DOCS = 2
MIN_CHARS = 10


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, plus ``n_lines`` and ``n_dropped`` (long).

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least ``min_chars``
    code points that occurs in at least ``min_docs`` documents keeps its lines in the smallest doc_id only.
    Lines are exploded and hashed to 128 bits; distinct documents are counted per hash (partial sums first, so
    a line that every document holds moves as one row per task); hits go back to their documents as positions.

    Null or empty text is one empty line. Rows with one doc_id are one document for the count; each is cut on
    its own. A null doc_id counts as the largest id. Other columns pass through; own names replace equal ones.
    """
    text = whole_text()
    base = docs.select(order_id().alias("id"), F.xxhash64(text).alias("copy"), F.split(text, "\n").alias("lines"), carried(docs, ["text"]))
    lines = docs.select(order_id().alias("id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = ascii_lower(F.expr("trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM line)"))
    keys = lines.withColumn("key", key).filter(F.char_length("key") >= min_chars).select("id", "copy", "pos", *hash128(F.col("key")))

    holders = keys.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    shared = (
        holders.groupBy("h1", "h2")
        .agg(F.count("one").alias("n_docs"), F.min("id").alias("first"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "first")
    )
    gone = (
        keys.join(shared, ["h1", "h2"])
        .filter(F.col("id") != F.col("first"))
        .groupBy("id", "copy")
        .agg(F.collect_set("pos").alias("gone"))
    )
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda p: F.get("lines", p)))
    out = base.join(gone, ["id", "copy"], "left").select(
        "row",
        F.array_join(kept, "\n").alias("kept"),
        n.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    return out.select(*uncarried(docs, {"text": F.col("kept"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}))
