"""License scan: matching statistics of a text against license templates, chained into covered spans."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from terrafold.llm.automaton import SuffixAutomaton
from terrafold.llm.common import map_texts, per_worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices as their licenses print them (public texts).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the rights "
            "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
            "whom the software is furnished to do so subject to the following conditions"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
               "the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
             "public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("all-rights-reserved", "all rights reserved"),
)

MIN_MATCH = 3
MAX_GAP = 8
COVERED = 0.8

# Bytes outside words become spaces; after lower-casing A-Z only digits, a-z and bytes above 0x7F are left.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
SPACES = bytes(b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(SPACES).split()


class Scanner:
    """The automaton of all templates over their words, and the phrases."""

    def __init__(self, templates, phrases, min_match: int, max_gap: int, covered: float):
        self.labels = [label for label, _ in templates]
        tokens = [words_of(text) for _, text in templates]
        self.ids = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.sizes = [len(t) for t in tokens]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in t] for t in tokens], occurrences=True)
        # per state: length of the match and the places of the templates that hold no longer suffix of it
        self.held = [self._held(state, min_match) for state in range(len(self.automaton.length))]
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.min_match, self.max_gap, self.covered = min_match, max_gap, covered

    def _held(self, state: int, min_match: int) -> list[tuple[int | None, list[tuple[int, int]]]]:
        """(length, places) along the suffix links: the whole match (None) first, then the shorter suffixes of
        ``min_match`` words or more, each for the templates that hold none of the longer ones."""
        out: list[tuple[int | None, list[tuple[int, int]]]] = []
        seen: set[int] = set()
        at = state
        while at > 0 and (at == state or self.automaton.length[at] >= min_match):
            places = [(t, p) for t, p in self.automaton.ends[at] if t not in seen]
            if places:
                out.append((None if at == state else self.automaton.length[at], places))
            seen |= {t for t, _ in places}
            at = self.automaton.link[at]
        return out

    def credits(self, words: list[bytes]) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """(end, length, places) of the longest match of every template that drops out of the matching statistics:
        where the match cannot be extended, or goes on in other templates only."""
        step, out = self.automaton.step, []
        state = matched = 0

        def ended(i: int, after: set[int]) -> None:
            for length, places in self.held[state]:
                n = matched if length is None else length
                gone = [(t, p) for t, p in places if t not in after]
                if n >= self.min_match and gone:
                    out.append((i, n, gone))

        for i, symbol in enumerate(map(self.ids.get, words)):
            before, had = state, matched
            now, length = (0, 0) if symbol is None else step(state, matched, symbol)
            if had >= self.min_match:
                # a template goes on if it holds its own match and the word after it
                goes_on = {}
                if length:
                    for n, places in self.held[now]:
                        for t, _ in places:
                            goes_on.setdefault(t, length if n is None else n)
                after = {t for n, places in self.held[before] for t, _ in places if goes_on.get(t, 0) > (had if n is None else n)}
                ended(i, after)
            state, matched = now, length
        if matched >= self.min_match:
            ended(len(words), set())
        return out

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(end, length, state) wherever a longest match of ``min_match`` words or more cannot be extended."""
        step, out = self.automaton.step, []
        state = matched = 0
        for i, symbol in enumerate(map(self.ids.get, words)):
            if symbol is None:
                if matched >= self.min_match:
                    out.append((i, matched, state))
                state = matched = 0
                continue
            before = (i, matched, state)
            state, now = step(state, matched, symbol)
            if now <= matched and matched >= self.min_match:
                out.append(before)
            matched = now
        if matched >= self.min_match:
            out.append((len(words), matched, state))
        return out

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share) of every chain of matches that covers enough.

        A chain continues at a later place of its template, at most ``max_gap`` words on in the text; what
        overlaps the words before counts once. Only the latest chain of a template is open, so the work is
        bounded by the matches.
        """
        open_: dict[int, list[int]] = {}  # template: first, end in text, end in template, covered words
        out = []

        def close(t: int) -> None:
            first, end, _, words_covered = open_.pop(t)
            if words_covered >= self.covered * self.sizes[t]:
                out.append((t, first, end - 1, min(1.0, words_covered / self.sizes[t])))

        for end, length, places in self.credits(words):
            latest: dict[int, int] = {}
            for t, position in places:
                chain = open_.get(t)
                p = position + 1
                fits = chain is not None and p > chain[2] and end - length - chain[1] <= self.max_gap
                if t not in latest or (fits and (not latest[t] > chain[2] or p < latest[t])):
                    latest[t] = p
            for t, p in latest.items():
                chain = open_.get(t)
                if chain is not None and p > chain[2] and end - length - chain[1] <= self.max_gap:
                    gained = min(length, p - chain[2], end - chain[1])
                    open_[t] = [chain[0], end, p, chain[3] + max(0, gained)]
                    continue
                if chain is not None:
                    close(t)
                open_[t] = [end - length, end, p, length]
        for t in list(open_):
            close(t)
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) wherever a phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            at, n = -1, len(phrase)
            while True:
                try:
                    at = words.index(phrase[-1], at + 1)
                except ValueError:
                    break
                if at >= n - 1 and words[at - n + 1 : at + 1] == phrase:
                    out.append((at - n + 1, label))
        return out


FIELDS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: bigint, last: bigint, covered: double>>"
)


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, covered: float = COVERED) -> DataFrame:
    """``docs`` without ``text`` plus license findings, one row per row of ``docs``.

    Words are runs of digits, letters and non-ASCII characters after A-Z became lower case. Base: every place
    of a phrase (n_base, first_word, last_word, base_labels). The method streams the words through a
    generalised suffix automaton of the templates, chains long matches per template, and adds the label of
    every template of which a chain covers at least ``covered`` (``spans``). Score: 1 with a base place, else
    the largest covered share, else 0. Null and empty texts have no words; own names replace equal columns.
    """
    own = {c.split()[0] for c in FIELDS.replace("spans array", "spans array ").split(", ")}
    settings = (tuple(templates), tuple(phrases), min_match, max_gap, covered)

    def start():
        scanner = per_worker("licenses", settings, lambda: Scanner(*settings))

        def scan(texts):
            rows = []
            for text in texts:
                words = words_of(text)
                places = scanner.places(words)
                spans = scanner.spans(words)
                base = {label for _, label in places}
                found = base | {scanner.labels[t] for t, *_ in spans}
                firsts = [p for p, _ in places]
                score = 1.0 if places else max((s[3] for s in spans), default=0.0)
                rows.append((
                    len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(found)), score,
                    [{"label": scanner.labels[t], "first": a, "last": b, "covered": c} for t, a, b, c in spans],
                ))
            return list(zip(*rows)) if rows else [[] for _ in range(8)]

        return scan

    return map_texts(docs.drop(*[c for c in docs.columns if c.lower() in own]), start, FIELDS)
