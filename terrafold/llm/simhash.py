"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering."""

from __future__ import annotations

import functools
import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import carried, map_texts, order_id, whole_text
from terrafold.llm.components import components
from terrafold.plans.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 8
# Near copies as the corpus pipeline takes them: fingerprints propose, shared five-word shingles decide.
NEAR_DISTANCE = 5
# The pipeline's radius: 99.1 % of the pairs of NEAR_SIMILARITY in check_s are within it, 54.7 % within 5 bits.
WIDE_DISTANCE = 11
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8
# Distinct texts meet if a band of least shingle hashes agrees: a pair that shares 0.8 of its shingles is missed
# with probability (1 - 0.8 ** BAND_ROWS) ** BANDS, 0.005.
BANDS, BAND_ROWS = 10, 4
HASHES_PER_BAND_BLOCK = 1_024
# Texts that meet are compared on a ring of four segments.
RING = 4
NODES_PER_BLOCK = 16_384
PAIRS_PER_STEP = 1 << 20
SKETCH_BITS = 512
# Keys that more fingerprints share are refined by the next segments of the ring.
KEY_ROWS = 256
# Shorter first keys are shared by many fingerprints in any table, so they are always refined.
LEAST_KEY_BITS = 16
HASHES_PER_BLOCK = 16_384


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, HASHES_PER_BLOCK):
        some = tokens[lo : lo + HASHES_PER_BLOCK + words - 1]
        shingles = map(b" ".join, zip(*[some[i:] for i in range(words)])) if n > 1 or len(tokens) == words else [b" ".join(tokens)]
        hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text`` plus ``fp``, the fingerprint as a signed long. Null text: fingerprint 0."""

    def start():
        return lambda texts: [[int(np.uint64(fingerprint(t, words)).astype(np.int64)) for t in texts]]

    return map_texts(docs, start, "fp bigint")


def shingle_set(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Distinct XXH64 hashes of the word shingles; fewer words: the whole sequence; none: no hash."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        shingles = iter([b" ".join(tokens)] if tokens else [])
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64)
    return np.unique(hashes).view(np.int64)


def links(prints: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, key_rows: int = KEY_ROWS) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints ``fp`` that differ in 1 to ``distance`` bits.

    Pigeonring: cut the bits into a ring of segments. If two fingerprints differ in at most d of them, some
    segment starts a chain whose first k segments differ in at most k * d / segments bits for every k. The
    first segments of such a chain have a budget below one, so they agree: they are the join key. The budgets
    of the longer chains are then checked one by one, and last the full distance. A pair is reported for the
    first viable start only.

    A key that more than ``key_rows`` fingerprints share is refined: the next segments of the chain have a
    budget of one bit or more, so each member probes its own value and all values within that budget on a
    longer key. That is exact; groups on the longer key hold at most 2^(bits left) fingerprints. A first key of
    less than ``LEAST_KEY_BITS`` bits is refined for all fingerprints, so the plan is the same at every size.
    """
    width = BITS // segments
    budget = [k * distance // segments for k in range(segments + 1)]
    exact = max(k for k in range(segments + 1) if budget[k] == 0)
    if not exact or BITS % segments:
        raise ValueError("take more segments than the distance, a divisor of 64")
    long = max(k for k in range(segments) if budget[k] <= 1)
    key_bits, long_bits = exact * width, long * width

    def turn(fp: str) -> Column:
        return F.expr(f"shiftleft({fp}, start * {width}) | (CASE WHEN start = 0 THEN 0L ELSE shiftrightunsigned({fp}, {BITS} - start * {width}) END)")

    ring = (
        prints.select("fp").distinct()
        .select("fp", F.explode(F.array(*[F.lit(i) for i in range(segments)])).alias("start"))
        .select("fp", "start", turn("fp").alias("ring"))
        .withColumn("key", F.shiftrightunsigned("ring", BITS - key_bits))
    )
    ring = written(ring, "simhash_ring")
    if key_bits >= LEAST_KEY_BITS:
        sizes = ring.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        ring = written(ring.join(sizes, ["start", "key"]), "simhash_keys")

    def pairs(probe: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
        a, b = probe.alias("a"), rows.alias("b")
        diff = F.expr("a.ring ^ b.ring")
        viable = F.col("a.fp") < F.col("b.fp")
        for c in on:
            viable = viable & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        for k in range(exact + 1, segments + 1):
            viable = viable & (F.bit_count(F.shiftrightunsigned(diff, BITS - k * width)) <= budget[k])
        return a.join(b, viable).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    short = F.shiftrightunsigned("ring", BITS - long_bits)
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(long_bits - key_bits)])

    def refined(rows: DataFrame) -> DataFrame:
        probes = rows.withColumn("long", F.explode(F.transform(flips, lambda x: short.bitwiseXOR(x))))
        return pairs(probes, rows.withColumn("long", short), ["start", "long"])

    if key_bits < LEAST_KEY_BITS:
        return refined(ring).distinct()
    light = ring.filter(F.col("n") <= key_rows)
    found = pairs(light, light, ["start", "key"]).union(refined(ring.filter(F.col("n") > key_rows)))
    return found.distinct()


def shingle_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' counts in SKETCH_BITS buckets: two sketches differ in no more bits than their
    sets differ in shingles, so a pair too far apart in it cannot be similar."""
    buckets = shingles.view(np.uint64) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(buckets.astype(np.int64), minlength=SKETCH_BITS) & 1, bitorder="little").tobytes()


@functools.cache
def band_factors() -> tuple[np.ndarray, np.ndarray]:
    """Seeded odd factors and offsets, one row for each hash of the bands."""
    rng = np.random.default_rng(42)
    factors = rng.integers(0, 2**64, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64) | np.uint64(1)
    return factors, rng.integers(0, 2**64, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key per band: the hash of BAND_ROWS least values of the shingles, each under an order of its own.

    Two sets agree in one least value with a probability of their Jaccard similarity. Texts without words share all keys.
    """
    import xxhash

    factors, offsets = band_factors()
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), HASHES_PER_BAND_BLOCK):
        some = shingles[lo : lo + HASHES_PER_BAND_BLOCK].view(np.uint64)
        np.minimum(least, (some[None, :] * factors + offsets).min(axis=1), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    keys = np.fromiter((xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(bands)), dtype=np.uint64)
    return keys.view(np.int64).tolist()


def ring_within(a: str, b: str, distance: int, segments: int = RING) -> Column:
    """True where some start on the ring has a chain within its budgets: its first k segments differ in at most
    k * distance / segments bits, for every k up to the whole ring, which is the full Hamming check."""
    width, diff = BITS // segments, F.expr(f"{a} ^ {b}")
    found = F.lit(False)
    for start in range(segments):
        ring = diff if not start else F.shiftleft(diff, start * width).bitwiseOR(F.shiftrightunsigned(diff, BITS - start * width))
        viable = F.lit(True)
        for k in range(1, segments + 1):
            viable = viable & (F.bit_count(F.shiftrightunsigned(ring, BITS - k * width)) <= k * distance // segments)
        found = found | viable
    return found


def similar_sizes(similarity: float) -> Column:
    """Sets of very different sizes cannot share that much."""
    return F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - F.lit(1e-6)


class Side:
    """Texts that share a key: node, fingerprint, number of shingles, sketch and the component so far."""

    def __init__(self, node: np.ndarray, comp: np.ndarray, size: np.ndarray, fp: np.ndarray, sketch: np.ndarray):
        self.node, self.comp, self.size, self.fp, self.sketch = node, comp, size, fp, sketch

    @classmethod
    def of(cls, table: pa.Table) -> Side:
        whole = lambda c: table.column(c).to_numpy()
        sketch = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype="<u8").reshape(table.num_rows, -1)
        return cls(whole("node"), whole("comp"), whole("n").astype(np.int64), whole("fp").view(np.uint64), sketch)

    def where(self, rows: np.ndarray) -> Side:
        return Side(self.node[rows], self.comp[rows], self.size[rows], self.fp[rows], self.sketch[rows])


def chain_viable(diff: np.ndarray, start: int, distance: int) -> np.ndarray:
    """The chain that begins at ``start`` stays within its budgets all around the ring."""
    width = BITS // RING
    ring = diff if not start else (diff >> np.uint64(start * width)) | (diff << np.uint64(BITS - start * width))
    viable = np.ones(len(diff), dtype=bool)
    for k in range(1, RING + 1):
        chain = ring if k == RING else ring & np.uint64((1 << (k * width)) - 1)
        viable &= np.bitwise_count(chain) <= k * distance // RING
    return viable


def block_pairs(a: Side, b: Side, distance: int, similarity: float):
    """Yields (rows of a, rows of b): fingerprints with a viable chain on the ring, in different components, and not
    ruled out by their numbers of shingles or their sketches. Each pair of rows once, for its first viable start.

    The first segment of a viable chain has a budget of distance // RING bits, so every row looks up all values
    within that of its own segment. At most PAIRS_PER_STEP pairs are held at a time.
    """
    width, budget = BITS // RING, distance // RING
    low = np.uint64((1 << width) - 1)
    flips = [sum(1 << i for i in c) for k in range(budget + 1) for c in itertools.combinations(range(width), k)]
    for s in range(RING):
        keys = ((b.fp >> np.uint64(s * width)) & low).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        starts = np.searchsorted(keys[order], np.arange((1 << width) + 1))
        mine = ((a.fp >> np.uint64(s * width)) & low).astype(np.int64)
        for flip in flips:
            first = starts[mine ^ flip]
            count = starts[(mine ^ flip) + 1] - first
            hit = np.flatnonzero(count)
            upto = np.concatenate([[0], np.cumsum(count[hit])])
            for lo in range(0, int(upto[-1]), PAIRS_PER_STEP):
                at = np.arange(lo, min(lo + PAIRS_PER_STEP, int(upto[-1])))
                k = np.searchsorted(upto, at, side="right") - 1
                i, j = hit[k], order[first[hit[k]] + at - upto[k]]
                keep = a.comp[i] != b.comp[j]
                i, j = i[keep], j[keep]
                diff = a.fp[i] ^ b.fp[j]
                keep = chain_viable(diff, s, distance)
                for t in range(s):
                    keep &= ~chain_viable(diff, t, distance)
                i, j = i[keep], j[keep]
                n, m = a.size[i], b.size[j]
                keep = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6
                i, j, n, m = i[keep], j[keep], n[keep], m[keep]
                apart = np.bitwise_count(a.sketch[i] ^ b.sketch[j]).sum(axis=1, dtype=np.int64)
                keep = apart <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6
                if keep.any():
                    yield i[keep], j[keep]


def hot_pairs(rows: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``rows`` (key, many, node, fp, n, bits, comp) that share a key of many texts.

    The texts of a key are dealt into blocks of a fixed size that meet in pairs. Texts of the component that most
    of two blocks belong to are compared with the others only, not with each other.
    """
    blocks = F.ceil(F.col("many") / NODES_PER_BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(9), "node"), "blocks").cast("int"))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.expr("sequence(own, blocks - 1)")))
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.expr("sequence(0, own)")))

    def search(one: pa.Table, other: pa.Table) -> pa.Table:
        found = [np.empty((0, 2), dtype=np.int64)]
        if one.num_rows and other.num_rows:
            a, b = Side.of(one), Side.of(other)
            comps, counts = np.unique(np.concatenate([a.comp, b.comp]), return_counts=True)
            most = comps[np.argmax(counts)]
            rest = a.where(a.comp != most)
            for x, y in ((rest, b), (a.where(a.comp == most), b.where(b.comp != most))):
                if len(x.node) and len(y.node):
                    for i, j in block_pairs(x, y, distance, similarity):
                        found.append(np.sort(np.column_stack([x.node[i], y.node[j]]), axis=1))
        pairs = np.concatenate(found)
        return pa.table([pa.array(pairs[:, k], type=pa.int64()) for k in range(2)], names=["a", "b"])

    out = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(search, "a bigint, b bigint")
    return out.distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts share at least ``similarity`` of their word shingles (Jaccard)."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("at_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("at_b"))
    shared = F.size(F.array_intersect("at_a", "at_b"))
    enough = shared >= F.lit(similarity) * (F.size("at_a") + F.size("at_b") - shared)
    return pairs.join(a, "a").join(b, "b").filter(enough).select("a", "b")


def similar_roots(docs: DataFrame, nodes: DataFrame, words: int, distance: int, similarity: float, key_rows: int = KEY_ROWS) -> DataFrame:
    """Rows (node, root) of the groups of ``nodes``, distinct texts, that links join; nodes without links are left out.

    Texts meet if they share a band key. A pair that meets is a candidate if a chain on the ring of fingerprints is
    viable, and a link if the texts share ``similarity`` of their shingles. First each text is checked against one
    smallest text of its keys, then against those of its other keys, last against all texts of its keys; from the
    second step on only pairs in different components are looked at, as others change no group. So a group of near
    copies does not meet in all its pairs. Only texts that share a key are shingled again, each once.
    """
    slim = nodes.select("node", F.explode("keys").alias("key"))
    shared = slim.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("first")).filter("many > 1")
    met = written(slim.join(shared, "key"), "simhash_met")
    chosen = written(nodes.join(met.select("node").distinct(), "node", "left_semi").drop("keys", "least"), "simhash_chosen")
    rows = docs.select(order_id().alias("id"), F.xxhash64(whole_text()).alias("node"), "text")

    def start():
        return lambda texts: [[shingle_set(t, words) for t in texts]]

    sets = map_texts(rows.join(chosen.select("id", "node"), ["id", "node"]).select("node", "text"), start, "shingles array<bigint>")
    sets = written(sets.dropDuplicates(["node"]), "simhash_sets")
    side = lambda c: chosen.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").alias(f"n_{c}"))

    def viable(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(ring_within("fp_a", "fp_b", distance))
        return near.filter(similar_sizes(similarity)).select("a", "b")

    stars = met.filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = written(confirmed(viable(stars.groupBy("b").agg(F.min("a").alias("a"))), sets, similarity), "simhash_links")
    roots = components(found)

    def joined(pairs: DataFrame) -> DataFrame:
        """The groups after the links among ``pairs``; the groups so far are stars already."""
        more = written(confirmed(written(pairs, "simhash_pairs"), sets, similarity), "simhash_links")
        return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    comp = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"comp_{c}"))
    apart = stars.distinct().join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    apart = apart.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
    roots = joined(viable(apart.select("a", "b")))

    placed = met.drop("first").join(roots, "node", "left").select("key", "many", "node", F.coalesce("root", "node").alias("comp"))
    placed = written(placed, "simhash_placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = written(placed.join(mixed, "key", "left_semi").join(chosen, "node"), "simhash_open")
    light = open_.filter(F.col("many") <= key_rows)
    a = light.select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "comp", "fp", "n")])
    b = light.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "fp", "n")])
    pairs = a.join(b, "key").filter("node_a < node_b AND comp_a <> comp_b").filter(ring_within("fp_a", "fp_b", distance))
    pairs = pairs.filter(similar_sizes(similarity)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return joined(pairs.union(hot_pairs(open_.filter(F.col("many") > key_rows), distance, similarity)).distinct())


def classes(
    docs: DataFrame, words: int = SHINGLE, distance: int = MAX_DISTANCE, segments: int = SEGMENTS,
    similar_words: int = NEAR_WORDS, similarity: float | None = None,
) -> DataFrame:
    """``docs`` without ``text``, plus ``fp``, ``root`` (the class) and ``component_id``.

    With ``similarity`` the distinct texts are linked, not the fingerprints, and a link counts only if the texts
    share that much of their ``similar_words`` shingles, also where the fingerprints are equal.
    """
    clash = [c for c in docs.columns if c.lower() in ("fp", "root", "component_id", "__copy", "__n", "__bits", "__keys")]
    docs = docs.drop(*clash)
    if similarity is None:
        prints = written(fingerprints(docs, words).withColumn("__copy", F.col("fp")), "simhash")
        nodes = prints.groupBy(F.col("__copy").alias("node")).agg(F.min("doc_id").alias("least"))
        roots = components(written(links(nodes.select(F.col("node").alias("fp")), distance, segments), "simhash_links"))
    else:

        def start():
            def run(texts):
                sets = [shingle_set(t, similar_words) for t in texts]
                prints = [int(np.uint64(fingerprint(t, words)).astype(np.int64)) for t in texts]
                return [prints, [len(s) for s in sets], [shingle_sketch(s) for s in sets], [band_keys(s) for s in sets]]

            return run

        marked = docs.withColumn("__copy", F.xxhash64(whole_text()))
        prints = written(map_texts(marked, start, "fp bigint, __n bigint, __bits binary, __keys array<bigint>"), "simhash")
        nodes = prints.groupBy(F.col("__copy").alias("node")).agg(
            F.min("doc_id").alias("least"), F.min(order_id()).alias("id"), F.first("fp").alias("fp"), F.first("__n").alias("n"),
            F.first("__bits").alias("bits"), F.first("__keys").alias("keys"),
        )
        nodes = written(nodes, "simhash_nodes")
        roots = similar_roots(docs, nodes, similar_words, distance, similarity)
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = written(named, "simhash_roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = named.join(ids, "root").select("node", "root", "component_id")
    return prints.drop("__n", "__bits", "__keys").join(table, F.col("__copy") == F.col("node")).drop("node", "__copy")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without ``text``, plus ``fp`` and ``component_id``, the smallest doc_id reachable by links.

    Only distinct fingerprints (with ``similarity`` distinct texts) are linked, so thousands of copies are one node. Empty and null texts share
    fingerprint 0. A null doc_id names no component; a component of null ids only has a null id. Repeated rows
    are each returned. Own names replace columns of the same name.
    """
    return classes(docs, **options).drop("root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest doc_id, null ids last.

    Rows that repeat that id: the one with the smallest text hash, and one of those that repeat both.
    """
    copy, id_ = F.xxhash64(F.coalesce("text", F.lit(""))), order_id()
    classed = classes(docs.select("doc_id", copy.alias("copy"), "text"), **options)
    best = classed.groupBy("root").agg(F.min(F.struct(order_id().alias("id"), F.col("copy"))).alias("b"), F.count(F.lit(1)).alias("n"))
    best = written(best.select(F.col("b.id").alias("id"), F.col("b.copy").alias("copy"), "n"), "simhash_best")
    rows = docs.select(id_.alias("id"), copy.alias("copy"), carried(docs)).join(best, ["id", "copy"])
    once = rows.filter("n = 1").union(rows.filter("n > 1").dropDuplicates(["id", "copy"]))
    return once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
