"""Manifests, collocations and I-Match fingerprints against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from barspark.llm import collocations, imatch, merkle, places, queries
from barspark.llm import textarrays as ta
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _i long, leaf string, `k 1` int"


def lower(x):
    return x.translate({i: i + 32 for i in range(65, 91)})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    """(leaf, subroot, root, proof, folded) of each row by loops."""
    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def steps(levels, i):
        out = []
        for level in levels[:-1]:
            run = i // 16 * 16
            out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
            i //= 16
        return out

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([plain_leaf(r) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))):
            path = steps(trees[s], i) + steps(top, k)
            x = plain_leaf((*r[:4], r[4] and lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else plain_leaf(r)
            for a, b in path:
                x = sha(a + x + b)
            out.append((r[0], plain_leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), x, x == top[-1][0]))
    return out


def test_manifest_is_the_plain_one(spark, tmp_path):
    rng = random.Random(1)
    sources = ["a"] * 40 + ["b", "é", "", None, "Z"] + [f"s{k}" for k in range(20)]
    rows = [(k, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, k]), rng.choice(["", None, "Abc É", "x" * 40, str(k)])) for k in range(1100)]
    rows += [(5, "a", None, 1, "again")] * 3 + [(None, "a", "en", 1, "T"), (None, None, None, None, None), (7, "only", "en", 1, "T")]
    spark.createDataFrame([(*r, 9, "leaf", 1) for r in rows], SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert sum(not r[-1] for r in got) > 20  # texts in which lower case differs


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(k, "s", "en", 1, "Text") for k in range(n)]
    spark.createDataFrame([(*r, 9, "leaf", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()) == sorted(plain_manifest(rows))


def test_blocks_climb_and_descend():
    leaves = [sha(str(i)) for i in range(35)]
    nodes = merkle.ascend(leaves, 2)
    runs = [sha("".join(leaves[i : i + 16])) for i in range(0, 35, 16)]
    assert list(nodes) == sorted(nodes) and next(reversed(nodes.values()))[0] == sha("".join(runs))
    paths = merkle.descend(nodes, [("l", "r")])
    assert paths[34] == [("".join(leaves[32:34]), ""), ("".join(runs[:2]), ""), ("l", "r")] and len(paths) == 35


def test_places_of_a_large_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 5000).alias("x"))
    got, most = places.numbered(rows, "g", ["x"], "test")
    byg = collections.defaultdict(list)
    for r in got.collect():
        byg[r.g].append((r.x, r._i, r._n))
    assert most == max(map(len, byg.values()))
    for own in byg.values():
        assert [i for _, i, _ in sorted(own)] == list(range(len(own))) and {n for _, _, n in own} == {len(own)}


def plain_collocations(rows, least, top, longest=3):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        found = []
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            if any(100 * b >= 50 * a for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((Fraction(10**6 * a * a, c[p[:k]] * c[p[k:]]).__floor__(), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, k + 1, p.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_are_the_plain_ones(spark, longest):
    rng = random.Random(2)
    vocabulary = ["New", "york", "é", "ÉA", "the", "a", "cat", "sat", "x\x00y", "city", "Los", "angeles"]
    rows = []
    for _ in range(300):
        words = [rng.choice(vocabulary[: rng.choice([3, 12])]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", " ? "]) for w in words)))
    rows += [("en", "new york city " * 40)] * 3 + [("en", None), ("fr", ""), (None, None), ("xx", "once only")]
    df = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, lang string, text string, word string, a int")
    got = [tuple(r) for r in collocations.collocations(df, collocations.Settings(longest=longest, top=25)).collect()]
    assert sorted(got) == sorted(plain_collocations(rows, 10, 25, longest)) and len(got) > 50


def test_collocations_of_an_empty_table_and_of_slices(spark, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(df).collect() == []
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 7)
    rng = random.Random(4)
    text = " ".join(rng.choice("abc") for _ in range(500)).encode()
    w = collocations.Words(__import__("pyarrow").array(["en"]), np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    everything = np.full(1 << 20, 2**64 - 1, np.uint64)
    got = collections.Counter()
    for keys, n in collocations.phrase_counts(w, 3, [everything, everything]):
        for *k, c in zip(*keys, n, strict=True):
            got[tuple(k)] += int(c)
    ws = text.decode().split()
    assert sorted(got.values()) == sorted(collections.Counter(zip(ws, ws[1:], ws[2:], strict=False)).values())


def test_tiles_count_like_a_counter(monkeypatch):
    rng = np.random.default_rng(6)
    left, right = (np.concatenate([rng.integers(0, 300, 40_000), rng.zipf(1.3, 20_000) % 200_000, rng.integers(0, 2**31, 5_000)]) for _ in range(2))
    for full in (1, 500, 10**9):
        monkeypatch.setattr(collocations, "FULL", full)
        got = {(a, b): n for a, b, n in zip(*(x.tolist() for x in collocations.tiled(left, right)), strict=True)}
        assert got == collections.Counter(zip(left.tolist(), right.tolist(), strict=True))


def test_sums_beyond_64_bits_are_exact(spark):
    words = spark.createDataFrame([("en", "x", 1, 10**12), ("en", "y", 2, 10**12 + 7)], "lang string, word string, key long, n long")
    parts = spark.createDataFrame([([1], 10**12), ([2], 10**12 + 7), ([1, 2], 999_999_999_989)], "p array<long>, a long")
    (row,) = collocations._best(words, words.groupBy("lang").agg(F.sum("n").alias("n")), parts, collocations.Settings()).collect()
    assert row.score == 10**6 * 999_999_999_989**2 // (10**12 * (10**12 + 7))


def plain_fingerprint(text, known, s):
    """By sets and loops; the hashes of words and subsets are the operator's own."""
    def word(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(ta.span_hashes(ta.BYTE_CODE, raw, np.array([0]), np.array([len(raw)]))[0])

    mix = lambda x: int(ta.mix(np.array([x % 2**64], np.uint64))[0])
    words = {word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))}
    terms = words & known if 4 * len(words & known) >= len(words) else words
    level, out = len(terms).bit_length(), []
    for at in range(level, level + imatch.SIZES):
        parts = [0] * s.subsets
        for again in range(max(1, s.subsets >> at)):
            for t in terms:
                u = mix(t + imatch._ODD * (1 + again + (s.seed << 16)))
                if (k := u % 2**at) < s.subsets:
                    parts[k + (again << at if at < 6 else 0)] += mix(u ^ imatch._ODD)
        out.append("".join(f"{max(1, mix(p) >> 32) if p % 2**64 else 0:08x}" for p in parts))
    return ":".join([f"{level:02d}", *out])


def test_fingerprints_are_the_plain_ones(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(80)] + [None, "", "", " \n", "Ünique word", "a", "same text here", "same text here", "common " * 50]
    texts += ["common and plain words"] * 40
    rows = [(3 * k, t, "x", 1.0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n_chars double").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    s = imatch.Settings()
    known = {r.term % 2**64 for r in imatch.lexicon(df).collect()}
    got = {r.doc_id: r for r in queries.op13_imatch(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        r = got[3 * k]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(changed))
        assert r.fingerprint == plain_fingerprint(t, known, s) and r.edited_fingerprint == plain_fingerprint(changed, known, s)
        for value, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, got[3 * ((k + 1) % len(texts))].fingerprint)):
            assert value == pytest.approx(plain_likeness(r.fingerprint, other))
    assert got[3 * 86].near_next == 1.0  # equal texts


def plain_likeness(a, b):
    if a == b:
        return 1.0
    la, lb = int(a[:2]), int(b[:2])
    at = max(la, lb)
    if abs(la - lb) >= imatch.SIZES:
        return 0.0
    x, y = (re.findall(".{8}", f.split(":")[1 + at - own]) for f, own in ((a, la), (b, lb)))
    some = [(p, q) for p, q in zip(x, y, strict=True) if (p, q) != ("0" * 8, "0" * 8)]
    return sum(p == q for p, q in some) / len(some) if some else 0.0


def test_a_large_lexicon_is_joined(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")  # ids repeat
    one, two = (sorted(map(tuple, imatch.against_edited(df, imatch.Settings(most_listed=m)).collect())) for m in (10**6, 0))
    assert one == two and len(one) == len(texts)
    one, two = (sorted(map(tuple, imatch.fingerprints(df, imatch.Settings(most_listed=m)).collect())) for m in (10**6, 0))
    assert one == two


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_texts_have_a_next_one(spark, tmp_path, n):
    spark.createDataFrame([(k, "some words of text") for k in range(n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_imatch(spark, str(tmp_path)).collect()
    assert len(got) == n and all(r.near_next == 1.0 for r in got)


def test_ids_may_be_null_or_text(spark):
    rows = [(None, "first of all"), ("b", "third text"), ("a", "second text"), (None, "first of all")]
    got = imatch.against_edited(spark.createDataFrame(rows, "doc_id string, text string"), share=1).collect()
    assert {(r.doc_id, r.edited_sha256) for r in got} == {(None, sha("first of all")), (None, sha("second text"[:12])), ("a", sha("third text")), ("b", sha("first of al"[:10]))}
