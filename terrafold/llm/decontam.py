"""Benchmark decontamination: windows of test words as a broadcast hash set, found in training texts and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import ascii_lower, carried, hash128, order_id, uncarried, whole_text
from terrafold.plans.session import bounded_broadcast, written

WINDOW = 10
# What stands between words, as ranges of code points, and the same with A-Z as word characters.
BREAK = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
BREAK_ANY_CASE = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"[^{BREAK}]+"), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item, len, h, win): all windows of all items, stored; an item shorter than a window is one window.

    ``item`` is the id as text. Null texts and texts without words have no window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window)).alias("len")
    starts = words.select("item", "w", length).select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at"))
    cut = starts.select("item", "len", F.slice("w", F.col("at") + 1, F.col("len")).alias("win")).distinct()
    return written(cut.withColumn("h", F.xxhash64("win")), "item-windows")


def _candidates(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (id, copy, at, len, w1, w2): every place whose words have the hash of a known window.

    A place is one hash per window length that occurs. The known windows are broadcast only if their counted rows
    are few; beyond that the join is an ordinary one on the hash, whose rows are distinct windows on one side."""
    w = F.col("w")
    base = docs.select(order_id().alias("id"), F.xxhash64("text").alias("copy"), words_of(F.col("text")).alias("w"))

    def places(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.lit(n).alias("len"), F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, n))).alias("hs"))

    # the words themselves are not carried through the explode
    each = base.select("id", "copy", F.explode(F.array(*[places(n) for n in lengths])).alias("p"))
    spread = each.select("id", "copy", F.col("p.len").alias("len"), F.posexplode("p.hs").alias("at", "h"))
    keys = known.select(F.col("len").alias("n"), F.col("h").alias("wh"), "w1", "w2")
    found = spread.join(bounded_broadcast(keys, keys.count()), (F.col("h") == F.col("wh")) & (F.col("len") == F.col("n")))
    return found.select("id", "copy", "at", "len", "w1", "w2")


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (id, copy, at, len, w1, w2): every place where a window stands; w1 and w2 name the window.

    Places are proposed by hash; then the words of the few documents with candidates are compared with the windows."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most ``window`` rows
    if not lengths:
        return docs.sparkSession.createDataFrame([], "id bigint, copy bigint, at int, len int, w1 bigint, w2 bigint")
    known = windows.groupBy("len", "h", "win").agg(F.lit(1).alias("one")).drop("one")
    known = written(known.select("*", *[c.alias(k) for c, k in zip(hash128(F.col("win")), ("w1", "w2"))]), "known-windows")
    found = written(_candidates(docs, known, lengths).distinct(), "candidates")
    held = written(found.select("id", "copy").distinct(), "candidate-texts")
    texts = docs.select(order_id().alias("id"), F.xxhash64("text").alias("copy"), "text").join(bounded_broadcast(held, held.count()), ["id", "copy"], "left_semi")
    words = texts.groupBy("id", "copy").agg(F.first("text").alias("text")).select("id", "copy", words_of(F.col("text")).alias("w"))
    wins = known.select("w1", "w2", "win")
    listed = found.join(bounded_broadcast(wins, wins.count()), ["w1", "w2"]).groupBy("id", "copy").agg(F.collect_list(F.struct("at", "len", "w1", "w2", "win")).alias("c"))
    same = F.filter("c", lambda c: F.slice("w", c["at"] + 1, c["len"]) == c["win"])
    proven = F.transform(same, lambda c: F.struct(*[c[k].alias(k) for k in ("at", "len", "w1", "w2")]))
    return words.join(listed, ["id", "copy"]).select("id", "copy", F.inline(proven))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, hit_positions: bool) -> DataFrame:
    """Rows (id, copy, n_hit, n_items, items, [hit]) of documents that hold a window."""
    windows = item_windows(benchmark, window)
    hits = written(_hits(docs, windows), "hits")
    covered = hits.select("id", "copy", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("at")).distinct()
    counted = covered.groupBy("id", "copy").agg(
        F.count(F.lit(1)).alias("n_hit"), *([F.collect_list("at").alias("hit")] if hit_positions else [])
    )
    # a document's windows before their items, so a window that stands in many places is looked up once
    held = hits.select("id", "copy", "w1", "w2").distinct()
    owners = windows.filter(F.col("item").isNotNull()).select("item", *[c.alias(k) for c, k in zip(hash128(F.col("win")), ("w1", "w2"))]).distinct()
    items = held.join(bounded_broadcast(owners, owners.count()), ["w1", "w2"]).select("id", "copy", "item").distinct()
    listed = items.groupBy("id", "copy").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return counted.join(listed, ["id", "copy"], "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str | None = "spans") -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items (long), items (array of item ids as text, sorted), contaminated.

    A window is ``window`` consecutive words of an item, or a whole shorter item; a document word inside any
    place where a window stands is hit. ``remove``: ``spans`` takes the hit words, with what stands before each,
    out of the text; ``documents`` drops documents with a hit; None only reports. n_words and n_hit describe the
    text that came in.

    Null texts and texts without words hold nothing, and stay. Items without id mark words but are in no list;
    several rows of one item_id are one item. Rows with one doc_id and text share one finding, each keeps its row;
    a null doc_id is a document like any other. Other columns pass through; own names replace equal ones.
    """
    text, spans = F.col("text"), remove == "spans"
    any_case = F.lit(f"[^{BREAK_ANY_CASE}]+")
    base = docs.select(
        order_id().alias("id"), F.xxhash64("text").alias("copy"), carried(docs, ["text"] if spans else []),
        F.size(F.regexp_extract_all(whole_text(), any_case, F.lit(0))).cast("bigint").alias("n_words"), *([text] if spans else []),
    )
    joined = base.join(_found(docs, benchmark, window, spans), ["id", "copy"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    added = {"n_words": F.col("n_words"), "n_hit": hit, "n_items": F.size(items).cast("bigint"), "items": items, "contaminated": hit > 0}
    if remove == "documents":
        joined = joined.filter(F.col("n_hit").isNull())
    if spans:
        # each piece is a word with what stands before it; what follows the last word is a piece of its own
        pieces = F.regexp_extract_all(text, F.lit(f"[{BREAK_ANY_CASE}]*[^{BREAK_ANY_CASE}]+|[{BREAK_ANY_CASE}]+$"), F.lit(0))
        # a column of its own, named twice below: inside the lambda it would be cut anew for every piece
        joined = joined.withColumn("pieces", F.when(F.col("hit").isNotNull(), pieces))
        left = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), "hit")
        rest = F.array_join(F.transform(left, lambda i: F.get("pieces", i)), "")
        joined = joined.withColumn("kept", F.when(F.col("pieces").isNull(), text).otherwise(rest))
        added["text"] = F.col("kept")
    return joined.select(*uncarried(docs, added))
