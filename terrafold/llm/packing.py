"""Packing of tokenised documents into sequences: best fit, then swap-based local search."""

from __future__ import annotations

import math
import sys
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import TEXTS_PER_CALL, per_worker
from terrafold.plans.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 0
PIECES_PER_GROUP = 20_000


# ---------------------------------------------------------------- tokens


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(json_path: str, ranks_path: str | None):
    """A function from a text to its ids. The ranks hold the same vocabulary for a faster encoder; texts that
    spell the special token, or that it refuses, go to the tokenizer file itself."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    if ranks_path is None:
        return plain
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str):
        if "<|" in text:
            return plain(text)
        try:
            return np.asarray(fast.encode_ordinary(text), dtype="<u4")
        except Exception:  # its pattern engine gives up on very long runs of white space
            return plain(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences, the first piece takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) for ``docs`` (doc_id, text); null text is empty."""
    if json_path is None:
        json_path, ranks_path = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    end = np.array([END_ID], dtype="<u4")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = per_worker("encoder", (json_path, ranks_path), lambda: encoder(json_path, ranks_path))
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_PER_CALL):
                part = batch.slice(lo, TEXTS_PER_CALL)
                out = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.concatenate([encode(text or ""), end])
                    out += [(i, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*out), kinds)], names=names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---------------------------------------------------------------- packing of one group


class Bins:
    """Bins of one capacity, found by their room. Pieces are indices into ``sizes``."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[tuple[int, int]]] = []  # sorted (size, piece)
        self.room: list[int] = []
        self.at: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r

    def _file(self, b: int, room: int) -> None:
        old = self.room[b]
        self.at[old].discard(b)
        if not self.at[old]:
            self.rooms &= ~(1 << old)
        self._enter(b, room)

    def _enter(self, b: int, room: int) -> None:
        self.room[b] = room
        self.at[room].add(b)
        self.rooms |= 1 << room

    def tightest(self, size: int, but: int = -1) -> int | None:
        """The bin with the least room of at least ``size``."""
        r, high = size, self.rooms >> size
        while high:
            step = (high & -high).bit_length() - 1
            r, high = r + step, high >> step
            for b in self.at[r]:
                if b != but:
                    return b
            r, high = r + 1, high >> 1
        return None

    def put(self, piece: int, b: int | None) -> None:
        if b is None:
            b = len(self.items)
            self.items.append([])
            self.room.append(self.capacity)
            self._enter(b, self.capacity)
        insort(self.items[b], (self.sizes[piece], piece))
        self._file(b, self.room[b] - self.sizes[piece])

    def take(self, piece: int, b: int) -> None:
        self.items[b].remove((self.sizes[piece], piece))
        self._file(b, self.room[b] + self.sizes[piece])


class Backs:
    """Which rooms the bins have that hold a piece of a size, for the pieces that an exchange can take back."""

    def __init__(self, bins: Bins):
        self.bins = bins
        self.held: list[dict[int, set[int]]] = [{} for _ in range(bins.capacity + 1)]  # size: room: bins
        self.rooms = [0] * (bins.capacity + 1)  # size: bit r for room r
        self.reach = np.full(bins.capacity + 1, -1, dtype=np.int64)  # size + the most room beside it, or -1
        for b in range(len(bins.items)):
            self.add(b)

    def add(self, b: int) -> None:
        room = self.bins.room[b]
        for size in {s for s, _ in self.bins.items[b]} if room else ():
            self.held[size].setdefault(room, set()).add(b)
            self.rooms[size] |= 1 << room
            self.reach[size] = size + self.rooms[size].bit_length() - 1

    def drop(self, b: int) -> None:
        room = self.bins.room[b]
        for size in {s for s, _ in self.bins.items[b]} if room else ():
            there = self.held[size][room]
            there.discard(b)
            if not there:
                del self.held[size][room]
                self.rooms[size] &= ~(1 << room)
                self.reach[size] = size + self.rooms[size].bit_length() - 1 if self.rooms[size] else -1


def _improve(bins: Bins, backs: Backs, e: int) -> bool:
    """One exchange out of bin ``e`` that raises the squared fill: a move, or the swap that gains most.

    A swap gives one piece or any two to a bin with room for what they exceed the piece that comes back. By size:
    the smallest piece that may come back is looked up among the bins that hold its size, so no bin is scanned."""
    own, spare = bins.items[e], bins.room[e]
    for size, piece in reversed(own):
        t = bins.tightest(size, but=e)
        if t is not None and bins.items[t] and size + spare > bins.room[t]:
            backs.drop(e)
            backs.drop(t)
            bins.take(piece, e)
            bins.put(piece, t)
            backs.add(e)
            backs.add(t)
            return True
    few: dict[int, list[int]] = {}
    for size, piece in own:
        few.setdefault(size, [])
        if len(few[size]) < 2:
            few[size].append(piece)
    sizes = list(few)
    out = {s: (few[s][0],) for s in sizes}
    for i, x in enumerate(sizes):
        for y in sizes[i:]:
            if x != y or len(few[x]) == 2:
                out.setdefault(x + y, (few[x][0], few[y][-1]))
    backs.drop(e)
    best: tuple[int, int, int] | None = None
    for size in out:
        for back in np.flatnonzero(backs.reach[:size] >= size).tolist():
            gain = size - back
            if best is not None and gain <= best[0]:
                break
            # a bin with room for the gain that ends up fuller than e is now
            fits = (backs.rooms[back] >> gain) & ((1 << spare) - 1)
            if fits:
                best = (gain, size, gain + (fits & -fits).bit_length() - 1)
                break
    if best is None:
        backs.add(e)
        return False
    gain, size, room = best
    t = min(backs.held[size - gain][room])
    back = bins.items[t][bisect_left(bins.items[t], (size - gain, -1))][1]
    backs.drop(t)
    bins.take(back, t)
    for p in out[size]:
        bins.take(p, e)
        bins.put(p, t)
    bins.put(back, e)
    backs.add(e)
    backs.add(t)
    return True


def pack(sizes: list[int], capacity: int = CAPACITY, rounds: int | None = None) -> tuple[list[int], list[int]]:
    """(bin, offset) of every piece. Largest first into the tightest bin; then bins, the emptiest first, give pieces
    to fuller ones, one for one, two for one or as moves, each raising the sum of squared fills. All bins are
    visited again until no exchange helps, or the number of bins reaches the total over the capacity. ``rounds``
    ends the search after so many exchanges."""
    bins = Bins(sizes, capacity)
    for p in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        bins.put(p, bins.tightest(sizes[p]))
    least = -(-sum(sizes) // capacity)
    used = sum(1 for x in bins.items if x)
    left = math.inf if rounds is None else rounds
    backs, changed = Backs(bins), True
    while changed and used > least and left > 0:
        changed = False
        for e in sorted(range(len(bins.items)), key=lambda b: (-bins.room[b], b)):
            while bins.items[e] and bins.room[e] and used > least and left > 0 and _improve(bins, backs, e):
                changed, left = True, left - 1
                used -= not bins.items[e]
    place, offset = [0] * len(sizes), [0] * len(sizes)
    for b, items in enumerate(bins.items):
        at = 0
        for size, p in items:
            place[p], offset[p], at = b, at, at + size
    return place, offset


# ---------------------------------------------------------------- all groups


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_group: int = PIECES_PER_GROUP, **tokens) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece of every row of ``docs``.

    A document is its token ids and the end id; a null text is empty and still holds the end id. Only documents
    longer than a sequence are cut. Whole sequences stand alone; the other pieces are dealt at random into
    groups of about ``per_group`` pieces, whatever source they come from, and each group is packed by itself:
    a group wastes about one sequence. Repeated rows are packed each on its own; other columns are ignored.
    """
    made = token_pieces(docs, capacity, **tokens).withColumn("rid", F.monotonically_increasing_id())
    pieces = written(made, "pieces")
    whole = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // per_group))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        place, offset = pack(table.column("length").to_pylist(), capacity)
        first = table.column("g")[0].as_py() << 32
        ids = pa.array((np.array(place, dtype=np.int64) + first), type=pa.int64())
        return table.drop_columns(["g", "rid"]).append_column("sequence_id", ids).append_column("offset", pa.array(offset, type=pa.int64()))

    dealt = rest.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("bigint"))
    packed = dealt.groupBy("g").applyInArrow(
        fill, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
    return whole.unionByName(packed)
