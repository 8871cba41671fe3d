"""Language identification by cross-parsing: the language whose text explains a document in fewest phrases."""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.automaton import SuffixAutomaton
from terrafold.llm.common import fold, map_texts, per_worker
from terrafold.plans.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The model is fitted on a bounded sample: about so many documents, at most so many characters, per language.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
CHARS_PER_DOC = 400
SEGMENT = 256
DENSE_ENTRIES = 1 << 21  # transitions of a language are an array up to this size, a sorted list of edges beyond
UNKNOWN, GAP, PAD = 0, 1, 2
FAIL = 1 << 30
UNDETERMINED = "und"


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _is_letter(point: int) -> bool:
    return chr(point).isalpha()


class Transitions:
    """The suffix automaton of one sample over the letters of that sample alone.

    A missing edge ends the phrase: flagged, and the symbol starts anew. A large alphabet has few edges for its states,
    so they are kept sorted instead of an entry for every state and letter.
    """

    def __init__(self, classes: np.ndarray, n_classes: int):
        own = np.unique(classes[classes > PAD])
        self.local = np.zeros(n_classes, dtype=np.int32)  # letters of other samples only are unknown here
        self.local[[GAP, PAD]] = GAP, PAD
        self.local[own] = np.arange(len(own)) + PAD + 1
        self.width = len(own) + PAD + 1
        edges = SuffixAutomaton([self.local[classes].tolist()]).next
        self.anew = np.full(self.width, FAIL, dtype=np.int32)
        for symbol, to in edges[0].items():
            self.anew[symbol] = to | FAIL
        listed = sorted((state * self.width + symbol, to) for state, by in enumerate(edges) for symbol, to in by.items())
        self.keys = np.array([k for k, _ in listed], dtype=np.int64)
        self.to = np.array([t for _, t in listed], dtype=np.int32)
        self.table = None
        if len(edges) * self.width <= DENSE_ENTRIES:
            table = np.tile(self.anew, len(edges))
            table[self.keys] = self.to
            table[PAD :: self.width] = np.arange(len(edges))
            self.table, self.keys, self.to = table, self.keys[:0], self.to[:0]

    @property
    def nbytes(self) -> int:
        arrays = (self.local, self.anew, self.keys, self.to, self.table)
        return sum(a.nbytes for a in arrays if a is not None)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state * self.width + symbol)
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        to = np.where(self.keys[at] == key, self.to[at], self.anew[symbol])
        return np.where(symbol == PAD, state, to)


class Parsers:
    """Transitions per language, over classes of characters that the samples contain."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        seen = sorted({int(p) for _, text in samples for p in np.unique(_points(text)) if _is_letter(int(p))})
        self.letters = np.array(seen, dtype=np.uint32)
        self.width = len(seen) + 3
        low = np.array([UNKNOWN if _is_letter(p) else GAP for p in range(0x3000)], dtype=np.uint16)
        self.low = low
        low[[p for p in seen if p < len(low)]] = [i + 3 for i, p in enumerate(seen) if p < len(low)]
        self.high = {p: i + 3 for i, p in enumerate(seen) if p >= len(low)}
        self.names = [name for name, _ in samples]
        self.tables, self.sizes = [], []
        for _, text in samples:
            classes = self.classes(text)
            self.tables.append(Transitions(classes, self.width))
            self.sizes.append(max(2, len(classes)))

    def classes(self, text: str) -> np.ndarray:
        """Character classes of a text; runs of anything but letters are one gap."""
        points = _points(text)
        out = self.low[np.minimum(points, len(self.low) - 1)]
        for i in np.flatnonzero(points >= len(self.low)):
            p = int(points[i])
            out[i] = self.high.get(p, UNKNOWN if _is_letter(p) else GAP)
        again = np.zeros(len(out), dtype=bool)
        again[1:] = (out[1:] == GAP) & (out[:-1] == GAP)
        return out[~again]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases[text, language], characters[text]). Texts are read in segments, all segments in step, so one
        long text costs no more than many short ones; a phrase also ends where its segment ends."""
        classes = [self.classes(t) for t in texts]
        lengths = np.array([len(c) for c in classes], dtype=np.int64)
        segments = np.maximum(1, -(-lengths // SEGMENT))
        starts = np.concatenate([[0], np.cumsum(segments)])
        flat = np.full(int(starts[-1]) * SEGMENT, PAD, dtype=np.int32)
        for c, s in zip(classes, starts):
            flat[s * SEGMENT : s * SEGMENT + len(c)] = c
        columns = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T)
        counts = np.zeros((len(texts), len(self.tables)), dtype=np.int64)
        for k, table in enumerate(self.tables):
            state = np.zeros(columns.shape[1], dtype=np.int32)
            ended = np.ones(columns.shape[1], dtype=np.int64)
            for column in columns:
                to = table.step(state, table.local.take(column))
                ended += to >> 30
                state = to & (FAIL - 1)
            counts[:, k] = np.add.reduceat(ended, starts[:-1])
        return counts, lengths

    def predict(self, texts: list[str | None]) -> list[list]:
        import regex

        letter = regex.compile(r"\p{L}")
        whole = [t or "" for t in texts]
        names, scores = [], []
        if not self.tables:
            return [[UNDETERMINED] * len(texts), [0.0] * len(texts)]
        counts, lengths = self.phrases(whole)
        bits = np.array([math.log2(n) for n in self.sizes])
        # an estimate of the cross entropy in bits per character
        entropy = counts * bits / np.maximum(1, lengths)[:, None]
        for text, row in zip(whole, entropy):
            if not letter.search(text):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            k = int(row.argmin())
            names.append(self.names[k])
            scores.append(float(1.0 / np.exp2((row.min() - row) * 4.0).sum()))
        return [names, scores]


def language_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, text) from documents outside fold 0 with a language, in order of the language.

    Texts are drawn by a hash of the text, copies once, at a rate that gives about ``sample_docs`` per language (all,
    if there are fewer), from each up to CHARS_PER_DOC characters of its middle. They are taken in the order of that
    hash, so every id has the same chance, until there are ``sample_chars`` characters."""
    known = docs.filter(F.col("lang").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0) & (fold() != 0))
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang_counts")
    draw = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1_000_000_000)) / F.lit(1e9)
    middle = F.greatest(F.lit(1), (F.length("text") / 2 - CHARS_PER_DOC // 2).cast("int"))
    drawn = (
        known.select("lang", F.substring(F.col("text"), middle, F.lit(CHARS_PER_DOC)).alias("text"), draw.alias("draw"))
        .join(counts, "lang")
        .filter(F.col("draw") * F.col("n") < sample_docs)
        .select("lang", "draw", "text")
        .distinct()
    )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["draw", "text"])
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "text": ["\n".join(ordered["text"])[:sample_chars]]})

    rows = drawn.groupBy("lang").applyInPandas(joined, "lang string, text string").collect()
    return tuple(sorted((r["lang"], r["text"]) for r in rows))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """``docs`` without ``text`` plus lang_pred and score (0 to 1, how far ahead the language is).

    Each text is parsed greedily into the longest substrings that a language's sample contains; phrases times
    the log of the sample size over the length estimates the cross entropy, and the smallest wins (ties: the
    first by code point). Null texts and texts without a letter, or no samples at all: ``und`` with score 0.
    """
    key = hashlib.sha256(repr(samples).encode("utf-8", "surrogatepass")).hexdigest()

    def start():
        parsers = per_worker("languages", key, lambda: Parsers(samples))
        return parsers.predict

    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    return map_texts(docs.drop(*clash), start, "lang_pred string, score double")
