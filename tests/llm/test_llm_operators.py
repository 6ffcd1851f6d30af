"""Operators against brute force, libraries and exact round trips."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import (bpe_prefix, chat_format, decontaminate, language_id, license_scan, line_dedup, ngram_join,
                           quality_rules, token_counts, warc)
from cohortlab.llm.common import min_label_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, component string, token long, at int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = []
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "ONE two"), (105, LONG), (106, LONG + " end"),
             (106, LONG + " end"), (None, "no id at all here"), (107, "MIT License, apache-license! CC BY\ncc by")]
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def components(sets, percent):
    par = {i: i for i in sets}

    def find(a):
        while par[a] != a:
            a = par[a]
        return a
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_ngram_join_matches_brute_force(docs):
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = WORD.findall(low(r.text))
        sets[r.doc_id] = set(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else ({tuple(w)} if w else set())
    got = rows_of(ngram_join.link_components(docs))
    assert len(got) == docs.count()
    want = components(sets, 85)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_min_label_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in min_label_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500}


def tricky_texts():
    rng = random.Random(5)
    bits = list("aabbet  '\n\t\r\x0b\x1c\x85\xa0é中😀0123..##") + ["'s", "<|endoftext|>", " the", "ing", "aaaa"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["a" * 20_000, "", " " * 300]


def test_prefix_encoder_matches_library_and_edits():
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe_prefix.PrefixEncoder(bpe_prefix.load_ranks(path), public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in tricky_texts():
        ids = enc.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert enc.decode(ids) == t.encode()
    old = b"internationalisation"
    last = enc.extend(old, [None])
    assert enc.extend(old + b"ism", list(last)) == enc.extend(old + b"ism", [None])
    assert enc.edit(old, last, b"interneurons") == enc.extend(b"interneurons", [None])


def test_prefix_encoder_edits_stop_near_the_edit():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc, rng = bpe_prefix.PrefixEncoder(bpe_prefix.load_ranks(path), public_tokenizers.PATTERN), random.Random(9)
    for n in [0, 1, 5, 40, 400] * 20:
        old = bytes(rng.choice(b"abcdeinst  .\xc3\xa9") for _ in range(n))
        a = rng.randint(0, n)
        b = min(n, a + rng.randint(0, 4))
        new = old[:a] + bytes(rng.choice(b"abest ") for _ in range(rng.randint(0, 5))) + old[b:]
        assert enc.edit(old, enc.extend(old, [None]), new) == enc.extend(new, [None])
    old = b"the cats and dogs of the town " * 2000
    last, grown, plain = enc.extend(old, [None]), [], enc.extend
    enc.extend = lambda data, out, upto=None: grown.append(upto - len(out) + 1) or plain(data, out, upto)
    out = enc.edit(old, last, b"x" + old)
    assert sum(grown) < 1000 and out == plain(b"x" + old, [None])


def test_pairs_by_undone_merges_equal_plain_merging():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc, rng = bpe_prefix.PrefixEncoder(bpe_prefix.load_ranks(path), public_tokenizers.PATTERN), random.Random(1)
    ids = [i for i in rng.sample(sorted(enc.tokens), 3000) if enc._split(i)]
    for a, b in list(zip(ids, ids[1:])) + [(rng.randrange(256, 2000), rng.randrange(256, 2000)) for _ in range(5000)]:
        if enc._split(a) and enc._split(b):
            pair = [enc.tokens[a], enc.tokens[b]]
            assert enc._compatible(a, b) == (enc._merge(pair[0] + pair[1]) == pair)
    # tokens ranked before their parts
    odd = {bytes([c]): c for c in range(97, 101)} | {b"cd": 10, b"bcd": 5, b"ab": 3, b"abcd": 2}
    enc = bpe_prefix.PrefixEncoder(odd, ".+")
    for _ in range(300):
        t = bytes(rng.choice(b"abcd") for _ in range(9))
        want = enc._merge(t)
        assert enc.encode_piece(t) == [odd[x] for x in want]


def test_heap_counts_match_library():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_counts.HeapCounter(path, public_tokenizers.PATTERN)
    for t in tricky_texts():
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_encoding_and_counts_on_odd_rows(docs):
    enc = rows_of(bpe_prefix.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    cnt = rows_of(token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
    assert len(enc) == len(cnt) == docs.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [r for r in enc if r["doc_id"] == 100] == [{"doc_id": 100, "n_tokens": 0, "ids_sha256": nothing, "decoded_sha256": nothing}]
    assert [r["n_tokens"] for r in cnt if r["doc_id"] == 101] == [0]
    assert [r["over_limit"] for r in cnt if r["doc_id"] == 105] == [True]


def test_license_phrases_and_spans(docs):
    got = {r["doc_id"]: r for r in rows_of(license_scan.scan_licenses(docs))}
    r = got[107]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (8, 4, 0, 6, "apache,cc-by,mit", 1.0)
    assert got[100]["n_words"] == 0 and got[100]["first_word"] is None and got[100]["score"] == 0.0
    s = license_scan.LicenseScanner(license_scan.TEMPLATES, license_scan.BASE_PHRASES, 4, 0.5)
    n, base, spans = s.scan("intro words " + license_scan.TEMPLATES["bsd"] + " the end")
    assert not base and spans == [("bsd", 2, n - 2, 1.0)]
    n, base, spans = s.scan("x " + license_scan.TEMPLATES["apache"].replace("except", "unless"))
    assert [b for _, b in base] == ["apache"] and spans[0][0] == "apache" and 0.9 < spans[0][3] < 1


def test_automaton_matching_statistics():
    rng = random.Random(2)
    seqs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(9)] for _ in range(4)]
    s = license_scan.LicenseScanner({str(i): " ".join(w.decode() for w in q) for i, q in enumerate(seqs)}, {"a b": "ab"}, 2, 0.5)
    text = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(300)]
    subs = {tuple(q[i:j]) for q in seqs + [[b"a", b"b"]] for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
    want = {i: max((k for k in range(1, 10) if k <= i + 1 and tuple(text[i + 1 - k:i + 1]) in subs), default=0) for i in range(300)}
    for i, _, size in s.matches(text):
        assert size == want[i]
    places = [i for i in range(299) if text[i:i + 2] == [b"a", b"b"]]
    assert [p for p, _ in s.scan(" ".join(w.decode() for w in text))[1]] == places


def test_warc_round_trip_and_rolls(spark, tmpdir_path):
    big = "x" * 300
    rows = [(5, "u5", big), (2, "u2", big), (9, "u\r\n9", big), (7, None, None), (8, "u8", "é" * 49), (3, "u3", "é" * 49),
            (None, "n", big), (2, "u2", big), (11, "u", "y\r\n\r\n" * 40)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string")
    manifest = warc.write_archive(pages, tmpdir_path + "/a", roll_bytes=200)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = rows_of(warc.read_archive(spark, tmpdir_path + "/a"))
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == collections.Counter(
        [(5, 300, "revisit", 2), (2, 300, "response", None), (2, 300, "response", None), (9, 300, "revisit", 2), (7, 0, "response", None),
         (8, 98, "response", None), (3, 98, "response", None), (None, 300, "response", None), (11, 200, "response", None)])
    again = warc.write_archive(pages, tmpdir_path + "/b", roll_bytes=200)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    empty = pages.where("page_id = -1")
    warc.write_archive(empty, tmpdir_path + "/c")
    assert warc.read_archive(spark, tmpdir_path + "/c").count() == 0


def test_warc_shards_follow_bytes_not_ids(spark, tmpdir_path):
    rng = random.Random(6)
    text = lambda i: f"{i} " + "".join(rng.choice("abcdefgh") for _ in range(400))
    ids = list(range(600)) + [10 ** 15, 2 ** 63 - 1, -2 ** 63] + [None] * 100 + [77] * 100
    rows = [(i, f"u{k}", text(k) if k % 3 else "same " * 60) for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = [warc.write_archive(pages.repartition(5), tmpdir_path + "/a", shard_bytes=40_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    made.append(warc.write_archive(pages.coalesce(1), tmpdir_path + "/b", shard_bytes=40_000))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = (sorted(map(tuple, m.collect())) for m in made)
    counts = [r[1] for r in a]
    assert a == b and len(a) > 8 and max(counts) < 2 * sum(counts) / len(counts) + 40
    got = rows_of(warc.read_archive(spark, tmpdir_path + "/a"))
    low = min(i for i, _, t in rows if i is not None and t.startswith("same"))
    want = collections.Counter((i, hashlib.sha256(t.encode()).hexdigest(), u, *(("revisit", low) if i is not None and t.startswith("same") and i > low
                               else ("response", None))) for i, u, t in rows)
    assert collections.Counter((r["page_id"], r["payload_digest"], r["url"], r["record_type"], r["refers_to"]) for r in got) == want


def test_warc_damaged_files_are_errors(spark, tmpdir_path):
    import gzip
    import io
    import os
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string")
    name = warc.write_archive(pages, tmpdir_path).first()["file"]
    path = os.path.join(tmpdir_path, name)
    with open(path, "rb") as f:
        whole = f.read()
    assert warc.read_archive(spark, tmpdir_path).count() == 200
    members = whole.split(b"\x1f\x8b\x08")
    assert len(gzip.GzipFile(fileobj=io.BytesIO(whole)).read()) > 0 and len(members) >= 200
    between = len(whole) - len(members[-1]) - 3
    spoiled = bytearray(whole)
    spoiled[len(whole) // 2] ^= 255
    for bad in (whole[:len(whole) // 2], whole[:between], whole + whole[between:], bytes(spoiled), b""):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception):
            warc.read_archive(spark, tmpdir_path).collect()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_language_model(docs.where("doc_id % 2 = 0"))
    got = language_id.predict_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string")
    assert {r["lang_pred"] for r in rows_of(language_id.predict_language(odd, model))} == {"und"}
    assert language_id.fit_language_model(docs.where("false")) is None


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k:k + 8])].append(k)
    marked = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w))


def test_quality_statistics_match_brute_force():
    rng = random.Random(4)
    for n in [0, 1, 7, 8, 9, 40, 200] * 6:
        t = "".join(rng.choice(["a", "b"]) + rng.choice([" ", "\n", "\t", " # ", "\xa0", "\x1c"]) for _ in range(n))
        assert quality_rules.statistics(t)[0] == brute_statistics(t)
    assert quality_rules.statistics(None)[0] == (0, 0, 0, 0, 0, True)


def test_boosted_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = ((x[:, 0] + rng.normal(scale=.5, size=600) < 0) | (x[:, 1] > 1)).astype(float)
    m = quality_rules.flatten_fit(x, y, signs=[-1, 0])
    grid = np.column_stack([np.linspace(-3, 3, 80), np.zeros(80)])
    assert (np.diff(quality_rules.score_trees(m, grid)) <= 1e-12).all()
    assert ((quality_rules.score_trees(m, x) > .5) == y).mean() > .8


def test_quality_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rules.fit_quality_model(docs, labels)
    got = {r["doc_id"]: r for r in rows_of(quality_rules.document_statistics(docs, model=model))}
    assert model is None and not got[100]["kept"] and got[0]["kept"] and got[0]["score"] is None


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "bye"),
             (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", "bye"), (5, 0, None, None),
             (6, 0, "user", ""), (2, 2, "user", "bye"), (None, 0, "user", "hi"), (7, None, "system", "s"), (7, 5, "user", "hi")]
    turns += [(8, k, "user", f"t{k}") for k in range(3000)] + [(9, k, "user", f"t{k}") for k in range(2500)]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, pos string")
    kept = {r["conv_id"]: (r["n_turns"], r["n_equal"]) for r in rows_of(chat_format.collapse_snapshots(df))}
    assert kept == {2: (3, 2), 5: (1, 1), 6: (1, 1), 7: (2, 1), 8: (3000, 1)}
    out = sorted((r["pos"], r["rendered"]) for r in rows_of(chat_format.format_chats(df)) if r["conv_id"] == 2)
    assert out == [(1, "<|im_start|>user\nhi<|im_end|>\n"), (2, "<|im_start|>assistant\nyo<|im_end|>\n"), (3, "<|im_start|>user\nbye<|im_end|>\n")]
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(n))
    shared, block = line(60), "\n".join(line(12) for _ in range(30))
    texts = {1: line(9) + "\n" + shared + "\n" + line(8), 2: line(30), 3: shared, 4: line(7) + "\n" + shared, 5: "a\n" + block,
             6: "q r\ns t\n" + block + "\nlast", 7: None, 8: "", 9: "tiny"}
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in texts.items()] + [(None, shared, 7, "k")], "doc_id long, text string, at int, key string")
    got = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.dedup_lines(df))}
    assert got[1] == texts[1] and got[2] == texts[2] and got[7] is None and got[8] == "" and got[None] == shared
    assert got[3] == "" and shared not in got[4] and got[5] == texts[5]
    assert len(got[6]) < 0.4 * len(texts[6]) and got[6].endswith("last")
    for t in texts.values():
        assert "".join(line_dedup.chunks_of(t or "")) == (t or "")
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    # keys too short to tell chunks apart: the bytes decide
    short = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.dedup_lines(df, key_bytes=0))}
    assert short == got


def test_line_dedup_rows_that_share_an_id(spark):
    shared, own = " ".join(f"s{i}" for i in range(50)), " ".join(f"o{i}" for i in range(50))
    df = spark.createDataFrame([(1, shared), (2, shared), (2, own), (2, shared)], "doc_id long, text string")
    got = sorted(r["text"] for r in rows_of(line_dedup.dedup_lines(df)))
    assert got == sorted([shared, "", own, ""])


def repeated_windows(texts, size=50):
    """(index, word) covered by a window of words that an earlier place holds, by brute force."""
    seen, out = set(), set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if key in seen:
                out.update((i, j) for j in range(k, k + size))
            seen.add(key)
    return out


def test_line_dedup_passages_inside_lines(spark):
    rng = random.Random(21)
    words = lambda n: [f"y{rng.randrange(10 ** 6)}" for _ in range(n)]
    passages = [words(50) for _ in range(40)]
    for p in passages[20:]:
        p[17] += "\n" + words(1)[0]
        p[39] += "\n" + words(1)[0]
    texts = [" ".join(words(rng.randint(9, 60)) + p + words(rng.randint(9, 60))) for p in passages * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in sorted(rows_of(line_dedup.dedup_lines(df)), key=lambda r: r["doc_id"])]
    assert got[:40] == texts[:40]
    assert len(repeated_windows(texts)) >= 40 * 50 and not repeated_windows(got)
    cut = [len(t.split()) - len(g.split()) for t, g in zip(texts[40:], got[40:])]
    assert min(cut) >= line_dedup.RUN_WORDS and sum(cut) >= 0.6 * 40 * 50
    # nothing but the passage is cut
    for t, g, p in zip(texts[40:], got[40:], passages):
        head, tail = (x.split() for x in t.split(" ".join(p)))
        assert g.split()[:len(head)] == head and g.split()[-len(tail):] == tail


def test_line_dedup_words_repeated_with_a_period(spark):
    texts = ["a first line\n" + "For " * 700 + "end", "b " + "up and down " * 90, "to fro " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in sorted(rows_of(line_dedup.dedup_lines(df)), key=lambda r: r["doc_id"])]
    assert repeated_windows(texts) and not repeated_windows(got)
    assert got[0].startswith("a first line\nFor ") and got[0].endswith("end") and got[1].startswith("b up and down")


def test_line_dedup_leaves_lines_that_stand_apart_elsewhere(spark):
    rng = random.Random(13)
    lines = [" ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(9)) for _ in range(12)]
    others = [" ".join(f"o{rng.randrange(10 ** 6)}" for _ in range(30)) for _ in range(12)]
    texts = [f"{o[:100]}\n{line}\n{o[100:]}" for o, line in zip(others, lines)] + ["\n".join(lines)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, `__doc` int, `a.b c` int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in rows_of(out)} == dict(enumerate(texts))


def test_line_dedup_cuts_only_what_stands_earlier(spark):
    """No 50-word repeat stays, and every cut word lies in 16 words, or in a short chunk of lines, that an earlier place holds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    texts = sorted(map(tuple, docs.collect()))
    got = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.dedup_lines(docs))}
    size, seen, chunks, cut_wrong, kept_long = line_dedup.RUN_WORDS, set(), set(), 0, 0
    repeats = repeated_windows([t for _, t in texts])
    for doc, text in texts:
        words, covered = WORD.findall(text), set()
        for k in range(len(words) - size + 1):
            key = tuple(words[k:k + size])
            if key in seen:
                covered.update(range(k, k + size))
            seen.add(key)
        at = 0
        for c in line_dedup.chunks_of(text):
            n, body = len(WORD.findall(c)), c.strip("\r\n \t")
            if n < size and sum(bool(x.strip()) for x in body.split("\n")) >= 2:
                if body in chunks:
                    covered.update(range(at, at + n))
                chunks.add(body)
            at += n
        # the words that no earlier place holds stay, in their order
        left = iter(WORD.findall(got[doc]))
        short = [w for j, w in enumerate(words) if j not in covered]
        cut_wrong += not all(w in left for w in short)
    kept_long = len(repeated_windows([got[d] for d, _ in texts]))
    assert (cut_wrong, kept_long) == (0, 0) and repeats


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    words = [f"k{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(25)] + [(90, None), (91, "")]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        q = rng.choice(items[:25])[1].split()
        if rng.random() < .6:
            q[rng.randrange(len(q))] = "other"
        rows.append((i, " ".join(w + q + w[:20]).upper(), "h"))
    rows += [(100, None, "h"), (None, items[0][1], "h"), (1, "again", "h")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string, h string"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    sh = lambda t: {tuple(w[k:k + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for k in range(len(w) - 4)}
    want = {}
    for i, t, _ in rows:
        for j, q in items:
            s = sh(q)
            if i is not None and s and len(s & sh(t)) >= .8 * len(s):
                want[i, j] = len(s & sh(t))
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in rows_of(decontaminate.contained_items(d, b))}
    assert want and got == want
    left = decontaminate.decontaminate(d, b)
    assert left.columns == d.columns and left.count() == sum(r[0] not in {i for i, _ in want} for r in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("label__", F.lit(1))
    src = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, src, d)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= src.count()
        src = out.cache()
    final = P.STAGES[-1][1](spark, src, d)
    assert final.count() == src.count() and final.columns[:2] == ["doc_id", "n_tokens"]


def test_prefixes_of_linked_sets_share_what_is_needed(spark):
    rng = random.Random(9)
    shingles = ngram_join.Shingler(4)
    for percent in (80, 85, 100):
        cases = []
        for _ in range(150):
            a = {rng.getrandbits(64) for _ in range(rng.randint(1, 60))}
            b = {x for x in a if rng.random() < 0.95} | {rng.getrandbits(64) for _ in range(rng.randint(0, 4))}
            both = len(a & b)
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            known = np.array(sorted(rng.sample(sorted(a | b), len(a | b) // 2)), np.uint64)
            common = (known, np.array([rng.randint(2, 5) for _ in known], np.int64))
            for order in range(ngram_join.ORDERS):
                first = [set(ngram_join.prefix(s, ngram_join.often_seen(s, common), order, percent).tolist())
                         for s in (np.array(sorted(x), np.uint64) for x in (a, b))]
                cases.append((len(a), len(b), len(first[0] & first[1])))
        got = spark.createDataFrame(cases, "n long, m long, shared long")
        assert cases and got.where(f"shared < {ngram_join.needed('n', 'm', percent)}").count() == 0
    assert len(shingles("A b\tc  D a B c d")) == 4 and len(shingles("one two")) == 1 and len(shingles(" \n")) == 0


def test_ngram_join_empty_table_and_clashing_columns(docs, spark):
    assert ngram_join.link_components(docs.limit(0)).count() == 0
    odd = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("rep", "n", "first", "token", "a.b", "gone")])
    kept = ngram_join.one_per_group(odd, 85, 4)
    assert kept.columns == odd.columns
    want = {r["component_id"] for r in rows_of(ngram_join.link_components(docs)) if r["component_id"] is not None}
    assert {r["doc_id"] for r in rows_of(kept)} == want | {None}
