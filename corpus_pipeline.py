"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last
return the columns of ``documents``; ``run`` writes each stage's rows as Parquet in the session's shared folder
and reads them back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import lines, mixing, packing, simhash, toxicity
from terrafold.llm.common import NOT_WHITE, read
from terrafold.plans.session import written

# The classifier and the seeded fold have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the stage's own documents."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    marked = docs.select(F.struct("*").alias("row"), "text")
    scored = toxicity.score_toxicity(marked, model)
    return scored.filter("predicted = 0").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the smallest one; n_chars follows the text.

    A document that keeps no line but empty ones goes, unless it came in that way."""
    out = lines.line_dedup(docs)
    blank = ~F.col("text").rlike(NOT_WHITE)
    kept = out.filter(~(blank & (F.col("n_dropped") > 0)))
    return kept.select(*[(F.length("text").cast("bigint") if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Fingerprints within 11 bits propose pairs; a pair is a link if its texts share 0.8 of their five-word shingles.
    """
    return simhash.keep_one(docs, distance=simhash.WIDE_DISTANCE, similarity=simhash.NEAR_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents repeat or drop out as the plan says."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix, each repetition on its own, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
