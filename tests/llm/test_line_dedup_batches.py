"""Operator 1: texts cut into units together give what each gives alone, and other columns pass as they are."""

import numpy as np

from cohortlab.llm import line_dedup as ld


def test_units_of_joined_texts_are_those_of_each_text():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = ["", " \n\n ", "a b\nc d\n\ne", "x " * 300, "one \u00e9t\u00e9\u00a0two\nthree"]
    texts += [" ".join(rng.choice(words, n)).replace(" w7 ", "\n") for n in rng.integers(1, 200, 40)]
    raws = [t.encode() for t in texts]
    raw = b"\n".join([*raws, b""])
    bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    for long_words, key_bytes in ((ld.LONG_WORDS, 8), (8, 8), (ld.LONG_WORDS, 0)):
        text, *units = ld.units_of_texts(raw, bounds, long_words, key_bytes)
        for i, r in enumerate(raws):
            got = sorted(zip(*(c[text == i].tolist() for c in units)))
            assert got == sorted(zip(*(c.tolist() for c in ld.units_of(r, long_words, key_bytes))))
            assert all(0 <= s < e <= len(r) for s, e, _ in got)


def test_many_short_texts_with_odd_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, None if i % 50 == 3 else f"own{i} head{i}\n{passage if i % 2 else f'tail{i}'}", {"k": i}, [i, None]) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>, `c d` array<int>").coalesce(1)
    got = {r["doc_id"]: r for r in ld.dedup_lines(docs).collect()}
    assert len(got) == 2500
    for i, text, m, a in rows:
        assert (got[i]["a.b"], got[i]["c d"]) == (m, a)
        if text is None or i % 2 == 0 or i == 1:
            assert got[i]["text"] == text
        else:
            assert got[i]["text"].startswith(f"own{i} head{i}") and len(got[i]["text"].split()) < 40
