"""The BPE operators against the libraries, and exact round trips."""

from __future__ import annotations

import base64
import random

import public_tokenizers as P
import pytest

from barspark.llm import bpe, tokencounts

ALPHABET = "aB'\n \t é9²Ⅷ日本ΣσŻ'stmdrevell’-!<|>́İ\x1c\x85 "
ODD = ["it's they've we'll I'm he'd 'sx 'rex x'vey \n'll  '  's", "<|endoftext|>hi <|startoftext|><|endoftext|>", "", "a" * 3000, "    ", "ΑΣ ΑΣ.", None, "twice", "twice"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    made = ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    # a column that is named like a result, and an id that is null
    return spark.createDataFrame([(i if i != 3 else None, x, -1) for i, x in enumerate(made)], "doc_id long, text string, n_tokens int").cache()


def test_encoding_is_the_librarys_and_decodes_to_the_text(texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(r.doc_id, r.text): library.encode_ordinary(r.text or "") for r in texts.collect()}
    got = bpe.encode(texts, path)
    assert got.columns == ["doc_id", "ids", "decoded"]
    by = {r.doc_id: r for r in got.collect()}
    for (i, text), ids in want.items():
        assert by[i].ids == ids
        assert bytes(by[i].decoded) == (text or "").encode()
    again = {r.doc_id: r.text for r in bpe.decode(got, path).collect()}
    assert all(again[i] == (text or "") for i, text in want)


def test_edits_go_on_from_the_table():
    coder = bpe.ByteBPE.from_file(P.path("byte_bpe_50k.tiktoken"))
    piece = bpe.Editable(coder, b"unbelievab")
    assert piece.append(b"ly") == coder.encode_piece(b"unbelievably")
    assert piece.replace(2, 4, b"xyz") == coder.encode_piece(b"unxyzlievably")


def test_every_token_of_the_vocabulary_is_coded_as_itself():
    coder = bpe.ByteBPE.from_file(P.path("byte_bpe_50k.tiktoken"))
    for token, piece in list(coder.bytes_of.items())[::97]:
        assert coder.encode_piece(piece) == [token]


def test_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in tokencounts.count_tokens(texts, P.path("word_bpe_49k.json")).collect()}
    for r in texts.collect():
        want = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (want, len((r.text or "").encode()), want > 2048)


def test_empty_table(texts):
    none = texts.limit(0)
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken")).count() == 0
    assert tokencounts.count_tokens(none, P.path("word_bpe_49k.json")).count() == 0


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_words_that_cancel_out_and_very_long_words(spark):
    """Words that a polynomial hash modulo a power of two takes for equal; and words far longer than a token."""
    rng = random.Random(5)
    texts = [" ".join(x) for n in (1024, 2048) for x in (thue_morse(n), thue_morse(n)[::-1])]
    texts += ["".join(rng.choice(a) for _ in range(n)) for n, a in ((3_000, "abcdefghijklmnopqrstuvwxyz"), (20_000, "etaoin"), (5_000, "日本語é"))]
    texts += ["the" * 4_000, " ".join("word%d" % i for i in range(60_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bytewise, wordwise = libraries()
    got = {r.doc_id: r for r in bpe.encode(df, P.path("byte_bpe_50k.tiktoken")).collect()}
    counted = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(df, P.path("word_bpe_49k.json")).collect()}
    for i, x in enumerate(texts):
        assert got[i].ids == bytewise.encode_ordinary(x) and bytes(got[i].decoded).decode() == x
        assert counted[i] == len(wordwise.encode(x, add_special_tokens=False).ids)


def test_equal_hashes_of_unequal_pretokens_are_told_apart(monkeypatch):
    import numpy as np

    from barspark.llm import pretokens

    monkeypatch.setattr(pretokens.Known, "hash", lambda self, points, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    coder = bpe._Worker(P.path("byte_bpe_50k.tiktoken"))
    bytewise, _ = libraries()
    for text in ("one two six ten won't tow", "two one unbelievable one", "six ten owt"):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin, _ = pretokens.starts(points, np.array([0, len(points)]), absorb=True)
        start = np.flatnonzero(begin)
        place = coder.known.index(text, points, start, np.append(start[1:], len(points)))
        ids = [i for p in place for i in coder.ids.flat[coder.ids.start[p] : coder.ids.start[p] + coder.ids.length[p]].tolist()]
        assert ids == bytewise.encode_ordinary(text)


def test_another_vocabularys_specials_are_found(tmp_path):
    import json

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        stored = json.load(f)
    stored["added_tokens"].append({**stored["added_tokens"][0], "content": "§mark§"})
    path = tmp_path / "own.json"
    path.write_text(json.dumps(stored), encoding="utf-8")
    assert tokencounts.WordBPE(str(path)).specials[-1] == "§mark§"
