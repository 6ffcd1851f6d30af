"""Licence scan with a generalised suffix automaton (operator 3).

The automaton holds the word sequences of licence templates and short
phrases.  A text streams through it word by word: at each word the automaton
gives the longest match ending there (matching statistics).  Maximal matches
of at least ``min_match`` words are chained, in order and without overlap in
the template, into spans with the share of the template they cover.  Short
phrases are found at every place, also inside longer matches: a phrase ends
at a word if its state is the current state or one of its suffix links and
the match is long enough.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.
Null or empty texts have no words and no labels (score 0, places null).
The automaton grows with the templates only; per text, memory is its words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from cohortlab.llm.common import lower_ascii_bytes, map_rows

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases that must be found, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening passages of well-known public licence notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted",
    "cc-by": "This work is licensed under a Creative Commons Attribution",
    "public-domain": "This is free and unencumbered software released into the public domain",
}

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(lower_ascii_bytes(text))


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.where: list[tuple[int, int]] = [(-1, -1)]     # (sequence, end position) of one occurrence
        for s, seq in enumerate(sequences):
            last = 0
            for pos, w in enumerate(seq):
                last = self._add(last, w, s, pos)

    def _state(self, length, nxt, link, where) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.where.append(where)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.where[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _add(self, last: int, w: bytes, seq: int, pos: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._state(self.length[last] + 1, {}, 0, (seq, pos)), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def walk(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v


class LicenseScanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int, min_cover: float):
        self.names = list(templates)
        self.seqs = [words_of(templates[n]) for n in self.names]
        keys = [(words_of(p), label) for p, label in phrases.items()]
        self.sam = SuffixAutomaton(self.seqs + [k for k, _ in keys])
        self.vocab = frozenset(w for m in self.sam.next for w in m)
        self.min_match, self.min_cover = min_match, min_cover
        ends: dict[int, list[tuple[int, str]]] = {}
        for k, label in keys:
            ends.setdefault(self.sam.walk(k), []).append((len(k), label))
        self.found: list[list[tuple[int, str]]] = [[] for _ in self.sam.next]
        for v in sorted(range(1, len(self.sam.next)), key=self.sam.length.__getitem__):
            self.found[v] = ends.get(v, []) + self.found[self.sam.link[v]]
        # every place of every template prefix position, to name the template(s) of a match
        self.text_of = [b" " + b" ".join(s) + b" " for s in self.seqs]

    def matches(self, words: list[bytes]):
        """Yield (end position, state, matching length) of the words in the vocabulary."""
        nxt, link, length, vocab = self.sam.next, self.sam.link, self.sam.length, self.vocab
        v = size = 0
        before = -2
        for i in [i for i, w in enumerate(words) if w in vocab]:
            if i != before + 1:
                v = size = 0
            before, w = i, words[i]
            while v and w not in nxt[v]:
                v = link[v]
                size = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                size += 1
            else:
                v = size = 0
            yield i, v, size

    def scan(self, text: str | None):
        words = words_of(text)
        base: list[tuple[int, str]] = []
        runs: list[tuple[int, int]] = []          # maximal matches (start, end), end exclusive
        open_run = None
        for i, v, size in self.matches(words):
            for n, label in self.found[v]:
                if n <= size:
                    base.append((i + 1 - n, label))
            if size >= self.min_match:
                if open_run and i + 1 - size <= open_run[0]:
                    open_run = (open_run[0], i + 1)
                else:
                    if open_run:
                        runs.append(open_run)
                    open_run = (i + 1 - size, i + 1)
        if open_run:
            runs.append(open_run)
        spans = self._chain(words, runs)
        return len(words), base, spans

    def _chain(self, words, runs):
        spans = []
        for name, seq, flat in zip(self.names, self.seqs, self.text_of):
            at = covered = 0                      # template words passed and covered
            start = end = None

            def close():
                if start is not None and covered / len(seq) >= self.min_cover:
                    spans.append((name, start, end, min(1.0, covered / len(seq))))
            for a, b in runs:
                b_text = b" " + b" ".join(words[a:b]) + b" "
                place = flat.find(b_text)
                if place < 0:
                    continue
                t = flat.count(b" ", 0, place + 1) - 1
                if start is not None and (t + max(0, end - a) < at or a - end > len(seq)):
                    close()
                    covered, start = 0, None
                if start is None:
                    start = a
                # words shared with the run before are counted once
                covered += b - max(a, end or 0) if covered else b - a
                at, end = t + (b - a), b
            close()
        return spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
                  min_match: int = 4, min_cover: float = 0.5) -> DataFrame:
    """Phrases and covered template spans of every whole text."""
    templates = TEMPLATES if templates is None else templates
    phrases = BASE_PHRASES if phrases is None else phrases

    def make():
        scanner = LicenseScanner(templates, phrases, min_match, min_cover)

        def row(doc_id, text):
            n, base, spans = scanner.scan(text)
            starts = [s for s, _ in base]
            labels = {b for _, b in base}
            return (doc_id, n, len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})),
                    1.0 if base else max((s[3] for s in spans), default=0.0),
                    [dict(zip(("label", "start", "end", "covered"), s)) for s in spans])
        return row
    return map_rows(docs, [id_col, text_col], SCHEMA, make)
