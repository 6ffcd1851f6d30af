"""Language identification by nearest centroid (operator 6).

Texts become normalised TF-IDF vectors of hashed 1- to 3-character n-grams
(letters lower-cased, everything else a blank).  Each language has several
centroids, found by spherical k-means over its training rows; a text gets the
language of the centroid with the highest cosine and is marked ``rejected``
if it is farther from it than nearly all training rows of that centroid.

The fit uses a bounded sample: at most ``per_lang`` rows a language, chosen
by a hash of the id; each row adds one vector of ``DIMS`` numbers.
Null texts, and texts without a letter, are ``und`` with score 0.  With no
training rows every text is ``und``.  Long texts are counted in blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import map_rows

DIMS = 4096
BLOCK = 1_000_000


def ngram_counts(text: str, dims: int = DIMS) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text, None without a letter."""
    total, tail, seen = np.zeros(dims), "", False
    for at in range(0, len(text), BLOCK):
        part = text[at:at + BLOCK].lower()
        clean = "".join(part.split("\x00"))
        codes = np.frombuffer((tail + clean).encode("utf-32-le", "surrogatepass"), "<u4")
        uniq = np.unique(codes)
        letters = np.array([chr(c).isalpha() for c in uniq.tolist()], bool)
        is_letter = letters[np.searchsorted(uniq, codes)]
        seen = seen or bool(is_letter.any())
        c = np.where(is_letter, codes, 32).astype(np.uint64)
        for n, mult in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
            if len(c) >= n:
                h = np.zeros(len(c) - n + 1, np.uint64)
                for k in range(n):
                    h = h * np.uint64(mult) + c[k:len(c) - n + 1 + k]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                total += np.bincount((h >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
        tail = (tail + clean)[-2:]
    return total if seen else None


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def fit_centroids(counts: np.ndarray, langs: list[str], clusters: int = 3, reject_quantile: float = 0.01) -> dict:
    """Idf, centroids, their languages and the cosine below which to reject."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1.0
    x = _unit(np.log1p(counts) * idf)
    names, cents, floors = [], [], []
    for lang in sorted(set(langs)):
        rows = x[[i for i, v in enumerate(langs) if v == lang]]
        c = rows[:1]
        while len(c) < min(clusters, len(rows)):          # farthest point first: no randomness
            c = np.vstack([c, rows[np.argmin((rows @ c.T).max(1))]])
        for _ in range(10):
            own = (rows @ c.T).argmax(1)
            c = _unit(np.array([rows[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))]))
        sims, own = (rows @ c.T).max(1), (rows @ c.T).argmax(1)
        for k in range(len(c)):
            names.append(lang)
            cents.append(c[k])
            floors.append(float(np.quantile(sims[own == k], reject_quantile)) if (own == k).any() else 0.0)
    return {"idf": idf, "centroids": np.array(cents).reshape(-1, counts.shape[1]), "langs": names,
            "floors": np.array(floors)}


def fit_language_model(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       per_lang: int = 300, clusters: int = 3) -> dict | None:
    """Fit on at most ``per_lang`` hash-chosen rows of each language."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    space = 1 << 30
    chosen = None
    for lang, n in sizes.items():
        part = (F.col(lang_col) == F.lit(lang)) & (
            F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(space)) < F.lit(int(space * min(1.0, 1.5 * per_lang / n))))
        chosen = part if chosen is None else chosen | part
    kept = rows.where(chosen)

    def make():
        def row(i, lang, text):
            v = ngram_counts(text)
            return i, lang, None if v is None else v.astype(np.float32).tobytes()
        return row
    got = map_rows(kept, [id_col, lang_col, text_col], "id long, lang string, vec binary", make)
    got = sorted(((r["lang"], r["id"], r["vec"]) for r in got.where("vec is not null").collect()),
                 key=lambda r: (r[0], r[1] is None, r[1] or 0, bytes(r[2])))
    taken: dict[str, int] = {}
    langs, vecs = [], []
    for lang, _, vec in got:
        if taken.setdefault(lang, 0) < per_lang:
            taken[lang] += 1
            langs.append(lang)
            vecs.append(np.frombuffer(vec, np.float32))
    return fit_centroids(np.array(vecs, float), langs, clusters) if vecs else None


def predict_language(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; only the text is read."""
    def make():
        def row(doc_id, text):
            v = ngram_counts(text) if text and model else None
            if v is None:
                return doc_id, "und", 0.0, True
            sims = model["centroids"] @ _unit(np.log1p(v) * model["idf"])
            k = int(sims.argmax())
            return doc_id, model["langs"][k], float(min(1.0, max(0.0, sims[k]))), bool(sims[k] < model["floors"][k])
        return row
    return map_rows(docs, [id_col, text_col], "doc_id long, lang_pred string, score double, rejected boolean", make)
