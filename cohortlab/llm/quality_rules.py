"""Quality rules: gradient-boosted trees over document statistics (operator 7).

Statistics of the whole text feed shallow boosted trees trained here (second
order gradients of the log loss, histogram splits).  Trees are flattened into
numpy node arrays and score all rows of a batch at once.  Features named in
``MONOTONE`` may only raise (+1) or lower (-1) the score: a split that breaks
its sign is not taken, and the bound at a split is passed down to both sides.

The fit uses at most ``max_train`` labelled rows, the ones with the smallest
hash of their id.  Without labels of both kinds only the base rules decide.
Null texts have no words and fail the base rules.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import map_rows

SYMBOLS = "#*$%&|<>"          # fixed value
WINDOW = 8                    # words a repeated window has
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "letter_share", "distinct_share"]
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
DEFAULT_THRESHOLD = 0.5
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows found at least twice.  Windows are named exactly by
    doubling (pairs of names of half windows), not by hashes."""
    names, width = ids.astype(np.int64), 1
    while width < window:
        if len(names) <= width:
            return 0
        a, b = names[:-width], names[width:]
        _, names, n = np.unique(a * (names.max() + 1) + b, return_inverse=True, return_counts=True)
        width *= 2
        if n.max() < 2:
            return 0
    twice = np.flatnonzero(np.bincount(names)[names] >= 2)
    if not len(twice):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[tuple, list[float]]:
    """Base statistics and model features of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    repeat = repeated_words(ids) if n >= WINDOW else 0
    failed = n < 20 or 100 * repeat > 30 * n
    letters = len(text.translate(_NO_LETTERS))
    feats = [math.log1p(n), chars / max(n, 1), symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1),
             letters / max(chars, 1), len(names) / max(n, 1)]
    return (n, chars, symbols, dup, repeat, failed), feats


_NO_LETTERS = {c: None for c in range(128) if not chr(c).isalpha()}


def flatten_fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
                l2: float = 1.0, min_rows: int = 5, signs: list[int] | None = None) -> dict:
    """Train; returns node arrays (feature, cut, left, right, value) and tree roots."""
    signs = signs or [0] * x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw = np.full(len(y), prior)
    nodes: list[list[float]] = []

    def grow(rows, g, h, level, low, high):
        weight = lambda gs, hs: float(np.clip(-gs / (hs + l2), low, high))
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, rate * weight(g[rows].sum(), h[rows].sum())])
        if level == depth or len(rows) < 2 * min_rows:
            return me
        cost = lambda gs, hs, w: gs * w + 0.5 * (hs + l2) * w * w
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (cost(gs, hs, weight(gs, hs)) - 1e-6, None)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            slot = np.searchsorted(cut, x[rows, j], side="left")
            gl = np.cumsum(np.bincount(slot, g[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, h[rows], len(cut) + 1))[:-1]
            nl = np.cumsum(np.bincount(slot, minlength=len(cut) + 1))[:-1]
            for k in np.flatnonzero((nl >= min_rows) & (len(rows) - nl >= min_rows)):
                wl, wr = weight(gl[k], hl[k]), weight(gs - gl[k], hs - hl[k])
                if signs[j] * (wr - wl) < 0:
                    continue
                c = cost(gl[k], hl[k], wl) + cost(gs - gl[k], hs - hl[k], wr)
                if c < best[0]:
                    best = (c, (j, cut[k], wl, wr))
        if best[1] is None:
            return me
        j, cut, wl, wr = best[1]
        mid, left = (wl + wr) / 2, x[rows, j] <= cut
        lo_hi = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[j]]
        a = grow(rows[left], g, h, level + 1, *lo_hi[0])
        b = grow(rows[~left], g, h, level + 1, *lo_hi[1])
        nodes[me][:4] = [j, cut, a, b]
        return me

    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        raw = raw + score_trees(_arrays(nodes, [first], 0.0, depth), x, link=False)
    return _arrays(nodes, roots, prior, depth)


def _arrays(nodes, roots, prior, depth) -> dict:
    m = np.array(nodes, float).reshape(-1, 5)
    return {"feature": m[:, 0].astype(int), "cut": m[:, 1], "left": m[:, 2].astype(int),
            "right": m[:, 3].astype(int), "value": m[:, 4], "roots": np.array(roots, int), "prior": prior, "depth": depth}


def score_trees(model: dict, x: np.ndarray, link: bool = True) -> np.ndarray:
    """Scores of all rows at once: every tree steps down ``depth`` times; a leaf points to itself."""
    at = np.tile(model["roots"], (len(x), 1))
    rows = np.arange(len(x))[:, None]
    for _ in range(model["depth"]):
        f = model["feature"][at]
        down = np.where(x[rows, np.maximum(f, 0)] <= model["cut"][at], model["left"][at], model["right"][at])
        at = np.where(f < 0, at, down)
    raw = model["prior"] + model["value"][at].sum(1)
    return 1 / (1 + np.exp(-raw)) if link else raw


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        model: dict | None = None, extra: list[str] | None = None,
                        schema_extra: str = "", threshold: float = DEFAULT_THRESHOLD,
                        with_features: bool = False) -> DataFrame:
    """Statistics, base verdict, and with a model its score and the verdict.
    ``extra`` columns (DDL in ``schema_extra``) pass through unchanged."""
    extra = extra or []
    schema = SCHEMA + ", features array<double>, score double, kept boolean" + schema_extra

    def make():
        def row(doc_id, text, *rest):
            base, feats = statistics(text)
            score = None if model is None else float(score_trees(model, np.array([feats]))[0])
            kept = not base[-1] and (score is None or score >= threshold)
            return (doc_id, *base, feats, score, kept, *rest)
        return row
    out = map_rows(docs, [id_col, text_col, *extra], schema, make)
    return out if with_features else out.drop("features")


def fit_quality_model(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, id_col: str = "doc_id",
                      text_col: str = "text", label_col: str = "quality") -> dict | None:
    """Train on the ``max_train`` labelled ids with the smallest hashes."""
    few = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("train_id")).agg(F.max(label_col).cast("int").alias("train_y"))
           .orderBy(F.xxhash64("train_id"), "train_id").limit(max_train))
    # at most max_train rows of two numbers: a proven bound
    rows = docs.join(F.broadcast(few), F.col(id_col) == F.col("train_id"))
    got = (document_statistics(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "train_y"),
                               extra=["train_y"], schema_extra=", train_y int", with_features=True)
           .select("doc_id", "features", "train_y").orderBy(F.xxhash64("doc_id"), "doc_id", F.col("features").cast("string"))
           .limit(max_train).collect())
    y = np.array([float(r["train_y"] > 0) for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return flatten_fit(np.array([r["features"] for r in got], float), y, signs=[MONOTONE.get(f, 0) for f in FEATURES])
