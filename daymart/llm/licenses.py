"""Licence scan: matching statistics of a generalised suffix automaton over licence templates, chained into spans."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, chunks, column, split_words

# Phrases that name a licence, and passages of public licence texts.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
    "with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
    "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your option any "
    "later version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
    "not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify "
    "publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
    "purpose commercial or non commercial and by any means",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}

#: a match of so many words counts towards a chain; a chain skips at most GAP words; it names its licence from
#: CHAIN words or from half of the template on
LEAST, GAP, CHAIN = 4, 12, 12


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (template, word after the end)


class SuffixAutomaton:
    """Generalised over several sequences: all their factors, each state with the places where they end."""

    def __init__(self, sequences: list[list[int]]):
        self.states = [State(0)]
        for number, seq in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(seq):
                last = self._extend(last, symbol)
                self.states[last].ends.append((number, at + 1))
        for s in sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length):
            if self.states[s].link > 0:
                self.states[self.states[s].link].ends += self.states[s].ends
        for s in self.states:
            s.ends = sorted(set(s.ends))

    def _split(self, p: int, q: int, symbol: int) -> int:
        """The state of the factors of q that reach it from p on."""
        copy = len(self.states)
        self.states.append(State(self.states[p].length + 1, self.states[q].link, dict(self.states[q].next)))
        while p >= 0 and self.states[p].next.get(symbol) == q:
            self.states[p].next[symbol] = copy
            p = self.states[p].link
        self.states[q].link = copy
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        q = self.states[last].next.get(symbol)
        if q is not None:  # another sequence has it already
            return q if self.states[q].length == self.states[last].length + 1 else self._split(last, q, symbol)
        new = len(self.states)
        self.states.append(State(self.states[last].length + 1))
        p = last
        while p >= 0 and symbol not in self.states[p].next:
            self.states[p].next[symbol] = new
            p = self.states[p].link
        if p < 0:
            self.states[new].link = 0
        else:
            q = self.states[p].next[symbol]
            self.states[new].link = q if self.states[q].length == self.states[p].length + 1 else self._split(p, q, symbol)
        return new

    def state_of(self, factor: list[int]) -> int:
        at = 0
        for symbol in factor:
            at = self.states[at].next[symbol]
        return at

    def statistics(self, seq: list[int]):
        """For each place the state and length of the longest factor that ends there."""
        states, at, length = self.states, 0, 0
        for symbol in seq:
            while at and symbol not in states[at].next:
                at = states[at].link
                length = states[at].length
            to = states[at].next.get(symbol)
            if to is None:
                at = length = 0
            else:
                at, length = to, length + 1
            yield at, length


class Scanner:
    """Phrases and templates as one automaton."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        texts = [*phrases.items(), *[(t, label) for label, t in templates.items()]]
        words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(t.encode())] for t, _ in texts]
        self.labels = [label for _, label in texts]
        self.sizes = [len(w) for w in words]
        self.n_phrases = len(phrases)
        self.automaton = SuffixAutomaton(words)
        self.shortest = min([LEAST, *self.sizes[: self.n_phrases]])
        # the phrases that are a suffix of a state's factors, so those of its links too: a longer match that runs from a
        # template into a phrase has a state of its own; they end wherever the match is long enough
        states = self.automaton.states
        self.phrases_at: list[list[int]] = [[] for _ in states]
        for k in range(self.n_phrases):
            if words[k]:
                self.phrases_at[self.automaton.state_of(words[k])].append(k)
        for s in sorted(range(1, len(states)), key=lambda s: states[s].length):
            self.phrases_at[s] += self.phrases_at[states[s].link]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Word count, phrase places (first word, phrase) and chains (first word, word after, template, share)."""
        words = split_words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate(([False], ids > 0, [False]))
        begin = np.flatnonzero(known[1:] & ~known[:-1])
        end = np.flatnonzero(~known[1:] & known[:-1])
        long = end - begin >= self.shortest
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int, int]] = []
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            before = (0, 0)
            for k, now in enumerate(self.automaton.statistics(ids[a:b].tolist()), a):
                state, length = now
                places += [(k + 1 - self.sizes[p], p) for p in self.phrases_at[state] if self.sizes[p] <= length]
                if before[1] >= LEAST and length <= before[1]:  # the match before could not be extended
                    matches += self._found(k, *before)
                before = now
            if before[1] >= LEAST:
                matches += self._found(b, *before)
        return len(words), places, self._chains(matches)

    def _found(self, end: int, state: int, length: int) -> list[tuple[int, int, int, int]]:
        return [(t, end - length, e - length, length) for t, e in self.automaton.states[state].ends if t >= self.n_phrases]

    def _chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Best chains of matches that follow each other in text and template; overlaps count once."""
        chains = []
        matches.sort()
        best: list[tuple[int, int, int]] = []  # covered words, chain's first word, chain's first match
        for i, (t, a, x, n) in enumerate(matches):
            cover, first, root = n, a, i
            j = i - 1
            while j >= 0 and matches[j][0] == t and a - matches[j][1] <= self.sizes[t] + GAP:
                _, a2, x2, n2 = matches[j]
                over = max(0, a2 + n2 - a, x2 + n2 - x)
                if a2 < a and x2 < x and over < n and a - a2 - n2 <= GAP and best[j][0] + n - over > cover:
                    cover, first, root = best[j][0] + n - over, best[j][1], best[j][2]
                j -= 1
            best.append((cover, first, root))
        top: dict[int, int] = {}
        for i, (cover, _, root) in enumerate(best):
            if root not in top or cover > best[top[root]][0]:
                top[root] = i
        for i in top.values():
            t, a, _, n = matches[i]
            cover, first, _ = best[i]
            if cover >= min(CHAIN, (self.sizes[t] + 1) // 2):
                chains.append((first, a + n, t, min(1.0, cover / self.sizes[t])))
        return sorted(chains)


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first_word: long, after: long, label: string, share: double>>"
)


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Licence findings per document; files are streamed, nothing is shuffled.

    Words are letters, digits and non-ASCII characters, A-Z in lower case. ``n_base`` counts the places of the
    phrases; ``spans`` are the covered template spans in word numbers; ``labels`` joins both. ``score`` is 1 where a
    phrase stands, else the largest covered share of a template, else 0. Null and empty texts have no words; repeated
    rows are answered one by one; an empty table gives an empty result; columns in ``keep`` are carried along.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates

    def start():
        scanner = Scanner(phrases, templates)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [_row(scanner, part.text(i)) for part in chunks(texts) for i in range(len(part))]
            span = pa.struct([("first_word", pa.int64()), ("after", pa.int64()), ("label", pa.string()), ("share", pa.float64())])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

        return work

    return annotate(docs, start, FIELDS, text_col, keep)


def _row(scanner: Scanner, text: bytes) -> tuple:
    n, places, chains = scanner.scan(text)
    base = sorted({scanner.labels[p] for _, p in places})
    labels = sorted({*base, *[scanner.labels[t] for _, _, t, _ in chains]})
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    score = 1.0 if places else max([share for *_, share in chains], default=0.0)
    spans = [{"first_word": a, "after": b, "label": scanner.labels[t], "share": share} for a, b, t, share in chains]
    return n, len(places), first, last, ",".join(base), ",".join(labels), score, spans


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    found = scan_licenses(docs, keep=(id_col,), **options)
    return found.select(column(id_col).alias("doc_id"), *[F.col(c) for c in "n_words n_base first_word last_word base_labels labels score".split()])
