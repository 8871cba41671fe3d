"""Personal data: base patterns seed a bootstrapped search for identifiers in the same contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import ascii_lower, carried, uncarried, whole_text
from terrafold.plans.session import written

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Where a match can only begin at the start of a run the run is tried once
# (\G: where the match before ended), and runs are possessive, so long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What may be an identifier: a run of characters other than white space that holds a digit or an at sign.
CANDIDATE = r"(?:\G|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CONTEXT_CHARS = 64
CONTEXT_WORDS = 2

ROUNDS = 3
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.6
MIN_SCORE = 0.6
SMOOTHING = 1.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Luhn's check of up to 19 digits: from the right every second digit counts double, less 9 above 9."""
    d = F.reverse(_digits(m))
    total = F.lit(0)
    for i in range(19):
        x = F.when(F.length(d) > i, F.ascii(F.substring(d, i + 1, 1)) - 48).otherwise(0)
        total = total + (x if i % 2 == 0 else F.when(x > 4, x * 2 - 9).otherwise(x * 2))
    return total % 10 == 0


def _small(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def valid(kind: Column, m: Column) -> Column:
    """Whether a base match counts: ip parts up to 255, 13 to 19 card digits and Luhn, 9 to 15 phone digits."""
    parts = F.split(m, "\\.")
    n = F.length(_digits(m))
    ip = F.forall(parts, _small)
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", (n >= 13) & (n <= 19) & _luhn(m))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .otherwise(F.lit(True))
    )


def _found(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """Array of (kind, k, gap, match): the k-th match and the text between it and the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern)
    pairs = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("k"), F.char_length(x["g"]).alias("gap"),
            F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("left"), x["m"].alias("match"),
        ),
    )
    return F.when(hint, pairs)


def _context(left: Column) -> Column:
    """The last words before a match, lower-cased, digits as 0; null if there are none."""
    words = F.filter(F.split(ascii_lower(left), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    words = F.slice(words, F.greatest(F.lit(1), F.size(words) - CONTEXT_WORDS + 1), F.lit(CONTEXT_WORDS))
    return F.when(F.size(words) > 0, F.regexp_replace(F.array_join(words, " "), "[0-9]", "0"))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: (rid, row, found), ``found`` an array of base matches and of candidates (``any``).

    Written at once, so that row numbers are given once and no text is read or moved again."""
    text = F.col("t")
    # every match holds one of these, so most texts are settled by a short look
    hints = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+"), "any": F.lit(True)}
    arrays = [F.coalesce(_found(text, k, p, hints[k]), F.array()) for k, p in {**PATTERNS, "any": CANDIDATE}.items()]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), carried(docs, ["text"]), whole_text().alias("t"))
    return written(rows.select("rid", "row", F.when(text.rlike("[0-9@]"), F.concat(*arrays)).alias("found")), "pii_rows")


def placed(rows: DataFrame) -> DataFrame:
    """Rows (rid, kind, start, stop, left, match): a match's place, in code points, is the sum of all gaps and
    matches of its kind before it."""
    each = rows.filter(F.col("found").isNotNull()).select("rid", F.explode("found").alias("o")).select("rid", "o.*")
    order = Window.partitionBy("rid", "kind").orderBy("k")
    stop = F.sum(F.col("gap") + F.char_length("match")).over(order).cast("bigint")
    return each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.char_length("match")).select(
        "rid", "kind", "start", "stop", "left", "match"
    )


def bootstrap(seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, context, confidence) of lexical patterns, scored on the graph of patterns and instances.

    An instance is an identifier's text, a pattern a kind with the words before. Seeds score 1 for their kind
    and all else 0. In every round a pattern's confidence is the mean score of its distinct instances, damped
    by SMOOTHING, and an instance that is no seed takes the score 1 - product(1 - confidence) over its patterns.
    Edges are distinct (context, instance) pairs; both directions aggregate partially before they move.
    """
    edges = written(
        seeds.select("context", F.col("match").alias("instance"), "kind")
        .union(candidates.select("context", F.col("match").alias("instance"), F.lit(None).cast("string")))
        .filter(F.col("context").isNotNull()).distinct(),
        "pii_edges",
    )
    per_context = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("seeds"))
    fertile = per_context.filter(F.col("seeds") >= MIN_SEEDS).select("context", "n")
    seeded = edges.filter(F.col("kind").isNotNull()).groupBy("context", "kind").agg(F.count(F.lit(1)).cast("double").alias("sure"))
    sure = written(seeded.join(fertile, "context"), "pii_patterns")
    open_edges = written(edges.filter(F.col("kind").isNull()).join(fertile.select("context"), "context").select("context", "instance"), "pii_open")
    scored = sure.select("kind", "context", (F.col("sure") / (F.col("n") + SMOOTHING)).alias("confidence"))
    for _ in range(rounds - 1):
        lacks = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
        instances = open_edges.join(scored, "context").groupBy("kind", "instance").agg((1 - F.exp(lacks)).alias("score"))
        likely = open_edges.join(instances, "instance").groupBy("kind", "context").agg(F.sum("score").alias("likely"))
        scored = written(
            sure.join(likely, ["kind", "context"], "left").select(
                "kind", "context", ((F.col("sure") + F.coalesce("likely", F.lit(0.0))) / (F.col("n") + SMOOTHING)).alias("confidence")
            ),
            "pii_scores",
        )
    return scored


def find_pii(docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without ``text``, plus n_email, n_ip, n_card, n_phone (base matches, long), base_sha256, spans and n_added.

    Base matches are leftmost and do not overlap within a kind; ones that fail their check are dropped. They
    seed the bootstrap: high-confidence patterns of two words before a seed add every candidate, a run of
    characters with a digit or an at sign, that follows such a pattern and touches no base match of any kind.
    ``spans`` lists all spans as kind:start:end by kind, then start, in code points; base_sha256 hashes the
    base ones written likewise. Null text is empty. Every row is its own document, repeated rows too; own
    names replace columns of the same name.
    """
    source = scan(docs)
    found = written(placed(source), "pii_found")
    base = found.filter(F.col("kind") != "any").filter(valid(F.col("kind"), F.col("match")))
    base = written(base.withColumn("context", _context(F.col("left"))), "pii_base")
    taken = base.select(F.col("rid").alias("r"), F.col("start").alias("s"), F.col("stop").alias("e"))
    free = found.filter(F.col("kind") == "any").join(
        taken, (F.col("rid") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("stop")), "left_anti"
    )
    free = written(free.withColumn("context", _context(F.col("left"))), "pii_free")
    patterns = bootstrap(base, free, rounds).filter(F.col("confidence") >= min_confidence)
    lacks = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
    added = (
        free.select("rid", "start", "stop", "context").join(patterns, "context")
        .groupBy("rid", "start", "stop", "kind").agg((1 - F.exp(lacks)).alias("score"))
        .filter(F.col("score") >= min_score)
        .groupBy("rid", "start", "stop").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("rank")
    spans = base.select("rid", rank, "start", "stop", F.lit(True).alias("base")).union(added.select("rid", rank, "start", "stop", F.lit(False)))
    per_row = spans.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "start", "stop", "base"))).alias("all"),
        *[F.count(F.when(F.col("base") & (F.col("rank") == i + 1), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
    )
    written_as = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )
    per_row = per_row.select(
        F.col("rid").alias("r"), *[f"n_{k}" for k in KINDS], "n_added",
        written_as(F.filter("all", lambda x: x["base"])).alias("base_spans"), written_as(F.col("all")).alias("spans"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit("")) if c.endswith("spans") else F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = source.join(per_row, F.col("rid") == F.col("r"), "left")
    return out.select(
        *uncarried(
            docs.drop("text"),
            {**{f"n_{k}": none(f"n_{k}") for k in KINDS}, "base_sha256": F.sha2(none("base_spans"), 256), "spans": none("spans"), "n_added": none("n_added")},
        )
    )
