"""Mixing of sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import NOT_WHITE, carried, uncarried
from terrafold.plans.session import written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 11
# Leading hex digits of the seeded order that deal a source into buckets.
BUCKET_DIGITS = 3


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_WHITE}+")), F.lit(0)).cast("bigint")


def seeded_order(seed: int = SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, total: int, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for ``sizes`` (source, source_size): shares of ``total`` by weight, none above its cap.

    Sources get the weights in turn by code point, null last. Sources whose share exceeds ``max_epochs`` times
    their size are clamped there and what they leave goes to the others by weight, until none exceeds. Each
    round is one aggregate over the sources; only two sums come back. Exact integers decide who is clamped.
    """
    order = F.col("source").asc_nulls_last()
    placed = written(
        sizes.repartitionByRange(order).sortWithinPartitions(order).select(
            "source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("at")
        ),
        "mix_placed",
    )
    # one row per partition, not per source
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    place = F.col("offset") + F.col("at")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = written(
        placed.join(offsets, "part").select("source", "source_size", (F.col("source_size") * max_epochs).alias("cap"), weight.cast("bigint").alias("weight")),
        "mix_sources",
    )
    exact = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else F.lit(c).cast("decimal(38,0)")
    clamped, rest, open_weight, n_clamped = F.lit(False), total, None, -1
    while True:
        got = table.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("taken"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(clamped.cast("int")).alias("n"),
        ).first()
        rest, open_weight = total - (got["taken"] or 0), got["open"] or 0
        if not open_weight or got["n"] == n_clamped:
            break
        n_clamped = got["n"]
        clamped = exact("weight") * exact(rest) > exact("cap") * exact(open_weight)
    share = F.lit(0.0) if not open_weight else (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(open_weight))
    return table.select(
        "source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def mix_plan(slim: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and where the fractional one ends.

    ``slim`` (source, id, size, u). The last, fractional repetition takes documents in seeded order up to the
    rest of the target. Sums per bucket of the order find the bucket where it ends, and only that bucket is
    ordered row by row, so a hot source is never sorted in one task.
    """
    bucket = F.substring("u", 1, BUCKET_DIGITS)
    sums = written(slim.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix_buckets")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    total = sums.agg(F.sum("words")).first()[0] or 0
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = (
        source_targets(sizes, total, weights, max_epochs)
        .withColumn("whole", whole)
        .withColumn("rest", F.floor("target").cast("bigint") - F.col("whole") * F.col("source_size"))
    )
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    ends = (
        sums.withColumn("before", before)
        .withColumnRenamed("source", "s")
        .join(plan.select(F.col("source").alias("s2"), "rest"), F.col("s").eqNullSafe(F.col("s2")))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("s"), F.col("bucket").alias("end"), F.col("before").alias("end_before"))
    )
    plan = written(
        plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix_plan"
    )
    # identical (id, size) rows share one step of the order
    last = (
        slim.withColumnRenamed("source", "s")
        .join(plan.select("source", "rest", "end", "end_before"), F.col("s").eqNullSafe(F.col("source")))
        .filter(bucket == F.col("end"))
        .groupBy("source", "rest", "end_before", "u", "id", "size")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = F.col("size") * F.col("n")
    upto = F.sum(step).over(Window.partitionBy("source").orderBy("u", F.col("id").asc_nulls_last(), "size")) - step + F.col("end_before")
    cut = (
        last.withColumn("upto", upto)
        .filter((F.col("upto") <= F.col("rest")) & (F.col("rest") < F.col("upto") + step))
        .select(
            F.col("source").alias("s"), F.col("u").alias("cut_u"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"),
            F.expr("(rest - upto) div n").alias("part"),
        )
    )
    return written(plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "end", "end_before"), "mix_cut")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` plus size, source_size, target, taken (words) and ``copies`` (whole rows for the mix).

    Size is the number of words between white space (null: 0). ``taken`` adds up to the whole part of the
    target in every source: whole repetitions of each document and one fractional repetition of the source,
    which takes documents in an order seeded by the id; the document at its end is taken in part, or not at
    all once sizes are used up. ``copies`` rounds that part to nothing or to a whole document. Rows that repeat
    an id and a size share the part evenly. Without any word all targets are 0. The plan, one row per source,
    is written first, so a broadcast of it depends on its measured size.
    """
    slim = written(
        docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("size"), seeded_order(seed).alias("u")),
        "mix_slim",
    )
    plan = mix_plan(slim, weights, max_epochs).withColumnRenamed("source", "plan_source")
    rows = docs.select(
        F.col("source").cast("string").alias("s"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("w"), seeded_order(seed).alias("u"), carried(docs)
    )
    joined = rows.join(plan, F.col("s").eqNullSafe(F.col("plan_source")))
    none = F.lit(2**63 - 1)
    at = F.struct(F.col("u"), F.coalesce("id", none), F.col("w"))
    cut = F.struct(F.col("cut_u"), F.coalesce("cut_id", none), F.col("cut_size"))
    extra = F.when(F.col("cut_u").isNull(), 0).when(at < cut, F.col("w")).when(at == cut, F.col("part")).otherwise(0)
    taken = (F.col("whole") * F.col("w") + extra).cast("bigint")
    more = F.when(F.col("cut_u").isNull() | (F.col("rest") == 0), 0).when(at < cut, 1).when((at == cut) & (F.col("part") * 2 >= F.col("w")), 1).otherwise(0)
    copies = (F.col("whole") + more).cast("int")
    return joined.select("row", F.col("w"), "source_size", "target", taken.alias("taken"), copies.alias("copies")).select(
        *uncarried(docs, {"size": F.col("w"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("taken"), "copies": F.col("copies")})
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as the plan says, with the columns of ``docs`` only."""
    planned = mix(docs.select(carried(docs), F.col("doc_id"), F.col("text"), F.col("source")), **options)
    repeated = planned.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
