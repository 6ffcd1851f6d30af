"""Byte-level BPE by prefix dynamic programming (operator 2).

For every byte prefix of a piece the last token of its encoding is unique:
the one token ending there that is its own encoding and that is compatible
with the last token of the prefix before it.  Storing these last tokens
encodes a piece in one pass, lets an encoding be extended byte by byte with
exact results, and re-encodes after an edit only until the old last tokens
come back.  An Aho-Corasick automaton lists the tokens that end at a byte;
whether two tokens stand beside each other is told by undoing their merges.

Null or empty texts give no ids.  Repeated rows each give their row.  An empty
table gives no rows.  Extra columns are ignored.  Pieces longer than ``CACHE_PIECE`` characters are
encoded but not cached, and the cache is emptied at ``CACHE_SIZE`` entries:
memory is bounded, results do not depend on it.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from cohortlab.llm.common import map_rows

CACHE_SIZE = 500_000
CACHE_PIECE = 48
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Encoder over ranks; ``pattern`` cuts a text into pieces first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.max_len = max(map(len, ranks), default=1)
        # finds all tokens that end at a byte, longest first
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), rank))
        self.endings.make_automaton()
        self._splits: dict[int, tuple[int, int, int, bool] | None] = {}
        self._pairs: dict[tuple[int | None, int], bool] = {}
        self._cache: dict[str, bytes] = {}

    def _merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain lowest-rank merging of a short byte string, down to ``stop`` parts."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int, int, bool] | None:
        """(left, right, rank, odd): the two tokens whose merge gives ``token``, ``odd`` if one of them ranks after it;
        a byte is itself twice with rank -1.  None if merging never gives the token."""
        data = self.tokens[token]
        if len(data) == 1:
            parts = token, token, -1, False
        else:
            ids = [self.ranks[x] for x in self._merge(data, 2)]
            parts = (*ids, token, any(len(self.tokens[x]) > 1 and x > token for x in ids)) if len(ids) == 2 else None
        self._splits[token] = parts
        return parts

    def _compatible(self, left: int | None, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (None: begin a piece)."""
        if len(self._pairs) > CACHE_SIZE:
            self._pairs.clear()
        split = self._splits[right] if right in self._splits else self._split(right)
        ok = self._pairs[left, right] = split is not None and (left is None or self._stays(left, right))
        return ok

    def _stays(self, left: int, right: int) -> bool:
        """Undo the merges of both sides from the last to the first: no merge
        across the border may come before the next of them (of equal ranks the
        left one is first).  A token ranked before its parts has no such order:
        then the pair is merged anew."""
        tokens, rank_of, splits, split = self.tokens, self.ranks.get, self._splits, self._split
        a, b, before = left, right, float("inf")
        x, y = splits.get(a) or split(a), splits.get(b) or split(b)
        while True:
            across = rank_of(tokens[a] + tokens[b])
            if across is not None and across < before:
                return False
            if x[3] or y[3]:
                pair = [tokens[left], tokens[right]]
                return self._merge(pair[0] + pair[1]) == pair
            if x[2] > y[2]:
                before, a = x[2], x[1]
                x = splits.get(a) or split(a)
            elif y[2] >= 0:
                before, b = y[2] + 1, y[0]
                y = splits.get(b) or split(b)
            else:
                return True

    def extend(self, data: bytes, last: list[int | None], upto: int | None = None) -> list[int | None]:
        """Grow ``last`` (rank of the last token per prefix, entry 0 for the
        empty one) to cover ``data``, or its first ``upto`` bytes; entries
        present already are taken as right."""
        upto = len(data) if upto is None else min(upto, len(data))
        start = max(0, len(last) - self.max_len)
        want, known, compatible, append = len(last) - 1 - start, self._pairs.get, self._compatible, last.append
        for at, (size, token) in self.endings.iter((data[start:upto] if start or upto < len(data) else data).decode("latin-1")):
            if at == want:
                left = last[-size]
                ok = known((left, token))
                if ok or ok is None and compatible(left, token):
                    append(token)
                    want += 1
        if len(last) <= upto:
            raise ValueError("the ranks lack a single byte")
        return last

    def edit(self, old: bytes, last: list[int | None], new: bytes) -> list[int | None]:
        """Last tokens of ``new`` from those of ``old``: the common prefix is
        kept, and the rest of the common suffix is copied once ``max_len``
        prefixes inside it end in the same tokens as in ``old``."""
        n, m = 0, min(len(old), len(new))
        while n < m and old[n] == new[n]:
            n += 1
        tail = 0
        while tail < m - n and old[-1 - tail] == new[-1 - tail]:
            tail += 1
        shift, width, out, end = len(new) - len(old), self.max_len, last[:n + 1], n
        while end < len(new):
            end = min(end + width, len(new))
            self.extend(new, out, end)
            first = end + 1 - width
            if first >= len(new) - tail and first - shift >= 0 and first >= 0 and out[first:] == last[first - shift:end - shift + 1]:
                return out + last[end - shift + 1:]
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:          # a piece that is a token stays one token
            return [whole]
        last, out, end = self.extend(data, [None]), [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def _packed(self, piece: str) -> bytes:
        ids = np.asarray(self.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= CACHE_PIECE:
            if len(self._cache) >= CACHE_SIZE:
                self._cache.clear()
            self._cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, get = [], self._cache.get
        for piece in self.pieces.findall(text):
            out.append(get(piece) or self._packed(piece))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> PrefixEncoder:
    """One encoder a process, so that tasks of a worker share its tables."""
    return PrefixEncoder(load_ranks(ranks_path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again; digests per row, with the
    ids themselves (``ids`` binary) if ``with_ids``."""
    def make():
        enc = encoder(ranks_path, pattern)

        def row(doc_id, text):
            ids = enc.encode(text or "")
            out = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                   hashlib.sha256(enc.decode(ids)).hexdigest())
            return out + (ids,) if with_ids else out
        return row
    return map_rows(docs, [id_col, text_col],
                    SCHEMA + (", ids binary" if with_ids else ""), make)
