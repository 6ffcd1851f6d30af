"""Token counts by heap-and-linked-list byte-pair merging (operator 5).

The symbols of a piece form a linked list; a heap holds its adjacent pairs
that have a merge rank.  The lowest (rank, position) is popped again and
again, stale entries are skipped, and the count is the number of initial
symbols minus the merges done: no identifiers are made.  O(n log n) per
piece, so a very long word is no special case.

Null or empty texts count 0 bytes and 0 tokens.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame

from cohortlab.llm.common import map_rows

CACHE_SIZE = 200_000
CACHE_PIECE = 48
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class HeapCounter:
    """Counts tokens as the vocabulary file describes (byte-level BPE)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        raw = lambda s: b"".join(map(back.__getitem__, s))
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces = regex.compile(pattern)
        self._cache: dict[str, int] = {}

    def count_piece(self, data: bytes) -> int:
        n = len(data)
        sym: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] is None or j >= n or self.rank.get((sym[i], sym[j])) != r:
                continue                       # an older pair stood here
            sym[i], sym[j] = sym[i] + sym[j], None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            merges += 1
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (r := self.rank.get((sym[a], sym[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return n - merges

    def _miss(self, piece: str) -> int:
        c = self.count_piece(piece.encode("utf-8"))
        if len(piece) <= CACHE_PIECE:
            if len(self._cache) >= CACHE_SIZE:
                self._cache.clear()
            self._cache[piece] = c
        return c

    def count(self, text: str) -> int:
        if self.special is None:
            parts, total = [text], 0
        else:
            parts = self.special.split(text)
            total = len(parts) - 1             # a special string is one token
        get = self._cache.get
        for part in parts:
            for piece in self.pieces.findall(part):
                total += get(piece) or self._miss(piece)
        return total


def count_tokens(docs: DataFrame, vocab_path: str, pattern: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        counter = HeapCounter(vocab_path, pattern)

        def row(doc_id, text):
            n = counter.count(text or "")
            return doc_id, len((text or "").encode("utf-8")), n, n > limit
        return row
    return map_rows(docs, [id_col, text_col], SCHEMA, make)
