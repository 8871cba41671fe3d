"""Vector code compression: a codebook per part of a vector, fitted by rounds that skip what bounds settle.

Every part of a vector keeps, beside its code, one lower bound: the distance to the second nearest entry as it was
in the round that last scanned the whole codebook, and that round's stamp. Codebooks of all rounds are kept, so in a
later round the bound sinks by the largest true net displacement of an entry between the two rounds, the norm of the
sum of its moves, which is never more than the sum of their norms. If the exact distance to the own entry is still
below the bound, no other entry can be nearest and the codebook is not scanned.
"""

from __future__ import annotations

import hashlib
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import carried, uncarried
from terrafold.plans.session import bounded_broadcast, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
ROWS_PER_CALL = 4_096
LONG = 2**63 - 1
LIMB = 10**15
# Sums of squares below this are exact in doubles.
EXACT = 2.0**53


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Borders of the parts; equal where ``parts`` divides the length."""
    at = [dim * p // parts for p in range(parts + 1)]
    return list(zip(at, at[1:]))


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vectors`` with ``__v``, the components floor(scale * x) as exact doubles; rows whose vector is null or
    holds a component that is null or not finite, scaled or not, are left out."""
    x = F.col("embedding")
    d = lambda e: e.cast("double") * F.lit(float(scale))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(d(e)) == F.lit(float("inf"))))
    # beyond 2^53 every double is whole already, and a long could not hold it
    whole = lambda e: F.when(F.abs(d(e)) < F.lit(EXACT), F.floor(d(e)).cast("double")).otherwise(d(e))
    return vectors.filter(x.isNotNull() & ~bad).withColumn("__v", F.transform(x, whole))


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries; Python integers where doubles could round."""
    if not rows.shape[1]:
        return np.zeros((len(rows), len(entries)))
    if _small(rows, entries):
        cross = rows @ entries.T
        return (rows * rows).sum(axis=1)[:, None] - 2 * cross + (entries * entries).sum(axis=1)[None, :]
    diff = _whole(rows)[:, None, :] - _whole(entries)[None, :, :]
    return (diff * diff).sum(axis=2)


def own_squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the entry beside it."""
    if not rows.shape[1]:
        return np.zeros(len(rows))
    diff = rows - entries if _small(rows, entries) else _whole(rows) - _whole(entries)
    return (diff * diff).sum(axis=1)


def _small(*arrays: np.ndarray) -> bool:
    top = max((float(np.abs(a).max(initial=0.0)) for a in arrays), default=0.0)
    return 4.0 * top * top * max(1, arrays[0].shape[1]) < EXACT


def _whole(a: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape)


def _float(a: np.ndarray) -> np.ndarray:
    """As doubles; whole numbers that no double holds become a very large one."""
    return a if a.dtype != object else np.vectorize(lambda x: float(min(x, 10**300)), otypes=[float])(a)


def displacement(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper limits of how far each entry has moved, as the crow flies, between two rounds."""
    return np.sqrt(_float(((new - old) ** 2).sum(axis=1))) * (1 + 1e-9) + 1e-6


class Assigner:
    """Assigns one part's rows against the newest codebook, given the codebooks of all rounds so far."""

    def __init__(self, history: list[np.ndarray]):
        self.history, self.now = history, len(history) - 1
        self.scanned = self.skipped = 0
        self.moved = [displacement(h, history[-1]) for h in history[:-1]]

    def first(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(rows)
        return self._scan(rows, np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.uint8))

    def again(self, rows: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray):
        """(code, bound, stamp) after this round; a bound keeps its stamp where it settles the row."""
        code, bound, stamp = code.astype(np.int64), bound.copy(), stamp.copy()
        own = np.sqrt(_float(own_squared(rows, self.history[-1][code]))) * (1 + 1e-9) + 1e-6
        low = np.empty(len(rows))
        for s in np.unique(stamp):
            here, moves = stamp == s, self.moved[s]
            order = np.argsort(moves)
            top = moves[order[-1]]
            # the farthest mover among the other entries
            other = np.where(code[here] == order[-1], moves[order[-2]] if len(order) > 1 else 0.0, top)
            low[here] = bound[here] - other
        open_rows = np.flatnonzero(~(own < low))
        self.skipped += len(rows) - len(open_rows)
        return self._scan(rows, open_rows, code, bound, stamp)

    def _scan(self, rows, which, code, bound, stamp):
        entries = self.history[-1]
        self.scanned += len(which)
        if len(which):
            d = squared(rows[which], entries)
            best = np.argmin(d, axis=1)  # the lower index of equal distances
            rest = _float(d).copy()
            rest[np.arange(len(which)), best] = np.inf
            # rounded down, so it is a bound; with one entry there is no second
            second = np.sqrt(np.maximum(rest.min(axis=1), 0.0)) * (1 - 1e-9)
            code[which], bound[which], stamp[which] = best, second, self.now
        return code, bound, stamp


def _books(history: list[list[np.ndarray]]) -> list[Assigner]:
    return [Assigner([h[p] for h in history]) for p in range(len(history[0]))]


def _packed(v: np.ndarray) -> bytes:
    """A vector in the narrowest type that holds it, the type's letter first."""
    top = np.abs(v).max(initial=0.0)
    kind = "h" if top < 2**15 else "i" if top < 2**31 else "d"
    return kind.encode() + v.astype("<" + kind).tobytes()


def _unpacked(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    rows = [np.frombuffer(b, dtype="<" + chr(b[0]), offset=1) for b in column.to_pylist()]
    return np.array(rows, dtype=float).reshape(len(rows), dim)


def _state(batch: pa.RecordBatch, parts: int) -> list[np.ndarray]:
    """(code, bound, stamp), a column per part."""
    kinds = (("code", "<u2"), ("bound", "<f8"), ("stamp", "u1"))
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t).reshape(batch.num_rows, parts) for c, t in kinds]


def _round(history: list[list[np.ndarray]], dim: int, parts: int, first: bool):
    """Assignment of one round over Arrow batches: state rows, then one row of sums per part and entry in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, span = _books(history), cuts(dim, parts)
        small, carried_type = True, None
        sums = [np.zeros((len(h), b - a)) for h, (a, b) in zip(history[0], span)]
        counts = [np.zeros(len(h), dtype=np.int64) for h in history[0]]
        for batch in batches:
            carried_type = batch.schema.field("row").type
            for lo in range(0, batch.num_rows, ROWS_PER_CALL):
                some = batch.slice(lo, ROWS_PER_CALL)
                v = _unpacked(some.column("v"), dim)
                codes, bounds, stamps = (np.empty((len(v), parts), dtype=t) for t in (np.int64, float, np.uint8))
                if not first:
                    old = _state(some, parts)
                for p, (a, b) in enumerate(span):
                    state = books[p].first(v[:, a:b]) if first else books[p].again(v[:, a:b], *[o[:, p] for o in old])
                    codes[:, p], bounds[:, p], stamps[:, p] = state
                    counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
                    # whole numbers: exact in doubles while small, in Python integers from then on
                    if small and np.abs(sums[p]).max(initial=0.0) + np.abs(v).max(initial=0.0) * len(v) >= EXACT:
                        small, sums = False, [_whole(x) for x in sums]
                    if small:
                        for c in range(a, b):
                            sums[p][:, c - a] += np.bincount(codes[:, p], v[:, c], len(sums[p]))
                    else:
                        np.add.at(sums[p], codes[:, p], _whole(v[:, a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(v), pa.int32()), *[some.column(c) for c in ("row", "v")],
                     *[pa.array([x.tobytes() for x in m], pa.binary()) for m in (codes.astype("<u2"), bounds.astype("<f8"), stamps)],
                     *[pa.nulls(len(v), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())))]],
                    names=["kind", "row", "v", "code", "bound", "stamp", "part", "entry", "count", "sums"],
                )
        if carried_type is None:
            return
        used = [(p, int(e)) for p in range(parts) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * len(used), pa.int32()), pa.nulls(len(used), carried_type), *[pa.nulls(len(used), pa.binary())] * 4,
             pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
             pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
             pa.array([[_limbs(int(x)) for x in sums[p][e]] for p, e in used], pa.list_(pa.list_(pa.int64())))],
            names=["kind", "row", "v", "code", "bound", "stamp", "part", "entry", "count", "sums"],
        )

    return run


def _next_book(found: DataFrame, book: list[np.ndarray]) -> list[np.ndarray]:
    """floor(sum / count) per component; entries without a part stay. What comes back is one codebook."""
    used = found.filter("kind = 1")
    counts = {(r["part"], r["entry"]): int(r["c"]) for r in used.groupBy("part", "entry").agg(F.sum("count").alias("c")).collect()}
    limbs = used.select("part", "entry", F.posexplode("sums").alias("at", "s")).select("part", "entry", "at", F.posexplode("s").alias("power", "limb"))
    sums: dict[tuple[int, int, int], int] = defaultdict(int)
    for r in limbs.groupBy("part", "entry", "at", "power").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["part"], r["entry"], r["at"]] += int(r["s"]) * LIMB ** r["power"]
    out = [b.copy() for b in book]
    for (part, entry, at), total in sums.items():
        value = total // counts[part, entry]
        if abs(value) >= EXACT and out[part].dtype != object:
            out[part] = _whole(out[part])  # beyond doubles: whole numbers of any size
        out[part][entry, at] = value
    return out


def _limbs(x: int) -> list[int]:
    """A whole number of any size in signed digits of base LIMB, the lowest first."""
    sign, rest, out = (-1 if x < 0 else 1), abs(x), []
    while rest or not out:
        rest, low = divmod(rest, LIMB)
        out.append(sign * low)
    return out


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in book for e in b for x in e).encode()).hexdigest()


@dataclass
class Compressed:
    """Coded rows, and the codebooks by vector length: parts, entries, components as whole doubles."""

    rows: DataFrame
    books: dict[int, list[np.ndarray]]
    scale: int

    def decoded(self) -> DataFrame:
        """``rows`` with ``approx``, the entries that the codes name, put together and scaled back."""
        books, scale = self.books, self.scale
        schema = f"row {self.rows.select(carried(self.rows)).schema['row'].dataType.simpleString()}, approx array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column("n").to_pylist(), batch.column("code").to_pylist())
                made = [np.concatenate([b[c].astype(float) for b, c in zip(books[n], code)]) / scale for n, code in pairs]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([m.tolist() for m in made], pa.list_(pa.float64()))], names=["row", "approx"])

        out = self.rows.select(carried(self.rows), F.size("embedding").alias("n"), "code").mapInArrow(run, schema)
        return out.select(*uncarried(self.rows, {"approx": F.col("approx")}))


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """The rows of ``vectors`` (vec_id, embedding, ...) that hold finite components only, plus ``code`` (array of one
    entry number per part), ``error`` (long) and ``codebooks_sha256``, with the codebooks.

    Components become floor(scale * x). A codebook starts as that part of the ``entries`` smallest vec_ids (all, if
    fewer; rows that repeat an id by their vectors, rows without id last). Each round assigns every part to the
    nearest entry, ties to the lower number, and replaces each entry in use by floor(sum / count); then parts are
    assigned once more. Only codebooks come to the driver: parts x entries x their width, whatever the rows.

    Vectors of another length have codebooks of their own; a length that ``parts`` does not divide is cut nearly
    equal, an empty vector has codes 0 and error 0. Errors beyond a long are kept at its end. Own names replace equal
    ones. Each round writes its rows, so a lost executor costs a part of one round.
    """
    raw = integer_vectors(vectors, scale).withColumn("__n", F.size("__v"))
    lengths = [r[0] for r in raw.groupBy("__n").agg(F.count(F.lit(1)).alias("c")).orderBy("__n").select("__n").collect()]
    made = {dim: _fit_length(vectors, raw.filter(F.col("__n") == dim), dim, parts, entries, rounds) for dim in lengths or [parts]}
    rows = reduce(DataFrame.unionByName, [df for df, _ in made.values()])
    return Compressed(rows, {dim: book for dim, (_, book) in made.items()}, scale)


def _fit_length(vectors: DataFrame, raw: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, list[np.ndarray]]:
    start = raw.select("vec_id", "__v").orderBy(F.col("vec_id").asc_nulls_last(), "__v").limit(entries).collect()
    matrix = np.array([r["__v"] for r in start], dtype=float).reshape(len(start), dim)
    span = cuts(dim, parts)
    book = [matrix[:, a:b].copy() for a, b in span]
    history = [book]
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x, dtype=float) for x in batch.column("__v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([_packed(x) for x in v], pa.binary())], names=["row", "v"])

    carry = raw.select(carried(vectors), "__v")
    kept = carry.schema["row"].dataType.simpleString()
    fields = f"row {kept}, v binary, code binary, bound binary, stamp binary"
    state = carry.mapInArrow(pack, f"row {kept}, v binary")
    result = "part int, entry int, count bigint, sums array<array<bigint>>"
    for r in range(rounds):
        step = state.mapInArrow(_round(list(history), dim, parts, r == 0), f"kind int, {fields}, {result}")
        found = written(step, "codes", partition_by="kind")
        book = _next_book(found, book)
        history.append(book)
        state = found.filter("kind = 0").select("row", "v", "code", "bound", "stamp")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(history)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_PER_CALL):
                some = batch.slice(lo, ROWS_PER_CALL)
                v = _unpacked(some.column("v"), dim)
                if rounds:
                    old = _state(some, parts)
                codes, error = np.empty((len(v), parts), dtype=np.int64), [0] * len(v)
                for p, (a, b) in enumerate(span):
                    codes[:, p] = (books[p].again(v[:, a:b], *[o[:, p] for o in old]) if rounds else books[p].first(v[:, a:b]))[0]
                    error = [e + int(d) for e, d in zip(error, own_squared(v[:, a:b], history[-1][p][codes[:, p]]))]
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array([min(e, LONG) for e in error], pa.int64())],
                    names=["row", "code", "error"],
                )

    coded = state.mapInArrow(last, f"row {kept}, code array<int>, error bigint")
    added = {"code": F.col("code"), "error": F.col("error"), "codebooks_sha256": F.lit(digest(book))}
    return coded.select(*uncarried(vectors, added)), book


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` plus ``label_error``, the errors summed over the rows of equal label, nulls together."""
    sums = written(coded.groupBy(F.col(label).alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum")), "label-errors")
    n = sums.count()
    joined = coded.drop("label_error").join(bounded_broadcast(sums, n), F.col(label).eqNullSafe(F.col("__label")), "left")
    return joined.withColumn("label_error", F.least(F.col("__sum"), F.lit(LONG)).cast("bigint")).drop("__label", "__sum")
