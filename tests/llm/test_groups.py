"""Near-duplicates, mixing and language-model scores against plain versions."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from barspark.llm import components, hpylm, minhash, mixing, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def copies(rng, n):
    """Texts, copies of copies with more and more edits, fragments that many share, and odd ones."""
    vocabulary = ["w%d" % i for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    out = []
    while len(out) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        if rng.random() < 0.4:
            words += passage
        out.append(words)
        for _ in range(rng.choice([0, 0, 3, 12])):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(words)
    return [" ".join(x) for x in out] + [None, "", " \n", "One Two", "one two", "x"] + ["w1 w2 w3 w4 w5 w6"] * 3


def test_minhash_groups(spark):
    texts = copies(random.Random(2), 400)
    sets = []
    for x in texts:
        w = WORD.findall((x or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    links = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    want = smallest(len(texts), links)
    df = spark.createDataFrame([(i, x, True) for i, x in enumerate(texts)], "doc_id long, text string, kept boolean").repartition(3)
    got = {r.doc_id: r for r in minhash.link(df).collect()}
    assert len(got) == len(texts)
    wrong = [i for i in got if got[i].component_id != want[i]]
    assert len(wrong) <= 0.005 * len(texts)  # hashing may miss a pair right at the limit
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (i == got[i].component_id) for i in got)


def test_minhash_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.link(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (9, "k")]
    assert {r.component_id for r in minhash.link(spark.createDataFrame(rows, schema)).collect()} == {None, 9}
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g h"), (3, "a b c d e f g h i")]  # the first reaches the last by the second
    assert {r.component_id for r in minhash.link(spark.createDataFrame(rows, schema)).collect()} == {3}
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, None)]
    got = sorted(map(tuple, minhash.link(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (7, 0, 7, True)], key=str)


def test_words_that_cancel_out_are_not_linked(spark):
    """Two words that a polynomial hash modulo a power of two takes for equal."""
    for n in (1024, 2048):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
        df = spark.createDataFrame([(1, x), (2, y), (3, x.upper())], "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.component_id for r in minhash.link(df).collect()} == {1: 1, 2: 2, 3: 1}
        assert hpylm.make_plan(df.selectExpr("doc_id AS id", "text"), hpylm.Settings()).words == 3  # x, y and the end


def test_large_buckets_are_cut(spark):
    """Chunks of few rows give the same groups as one block."""
    from barspark.llm import buckets

    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99)], "key long, node long")
    shared = buckets.shared_keys(rows.select("node"), lambda nodes: rows.join(nodes, "node"))
    assert shared.count() == 40
    large = buckets.large_keys(shared, 8)
    pairs = collections.Counter()
    blocks = collections.defaultdict(list)
    for r in buckets.blocks(shared, large).collect():
        blocks[r.lo, r.hi].append((r.side, r.node))
    assert max(map(len, blocks.values())) < 40
    for members in blocks.values():
        two = {s for s, _ in members} == {0, 1}
        for s, a in members:
            for t, b in members:
                if (two and s < t) or (not two and a < b):
                    pairs[min(a, b), max(a, b)] += 1
    assert set(pairs) == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    alone = buckets.blocks(shared, large, False).collect()
    assert sorted(r.node for r in alone) == list(range(40)) and all(r.lo == r.hi for r in alone)


def test_keys_of_very_many_nodes_do_not_meet_in_one_task(spark, monkeypatch):
    from barspark.llm import buckets

    monkeypatch.setattr(buckets, "ONE_IN", 2)
    monkeypatch.setattr(buckets, "OFTEN", 8)
    rows = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 5), (2, 6), (3, 7)], "key long, node long")
    shared = buckets.shared_keys(rows.select("node").distinct(), lambda nodes: rows.join(nodes, "node"))
    assert sorted(map(tuple, shared.select("key", "node").collect())) == [(1, i) for i in range(100)] + [(2, 5), (2, 6)]
    found = spark.createDataFrame([(1, "a", 40_000), (2, "b", 2)], "key long, name string, n long")
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (9, 4), (None, 5)], "key long, node long")
    got = {r.node: r["name"] for r in buckets.left_join(rows, found, "key", "n", 100).collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: None, 5: None}


def test_a_large_group_of_near_copies_in_small_chunks(spark, monkeypatch):
    """A chain of near copies over many chunks is one group, and rows that repeat an id or have none cost no pairs."""
    from barspark.llm import buckets

    monkeypatch.setattr(buckets, "CHUNK", 8)
    monkeypatch.setattr(buckets.large_keys, "__defaults__", (8,))
    monkeypatch.setattr(minhash, "PAIRED", 2)
    rng = random.Random(12)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i if i % 5 else None, " ".join(words)))
    rows += [(1_000, " ".join(f"y{i}" for i in range(40)))] * 30 + [(1_000, " ".join(f"y{i}" for i in range(41)))] * 30
    rows += [(2_000, " ".join(f"z{i}" for i in range(30)))]
    got = minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert collections.Counter(r.component_id for r in got) == {1: 150, 1_000: 60, 2_000: 1}


def test_sketches_rule_out_no_pair_above_the_limit():
    rng = np.random.default_rng(5)
    s = minhash.Settings(sketch=64)
    for size in (1, 5, 20, 60, 63, 64, 70, 400):  # whole sets and cut ones
        base = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        sets = [base[:size]] + [np.concatenate([base[k:size], base[size : size + k]]) for k in range(0, size + 1, max(1, size // 20))]
        images = [np.unique((minhash.ta.mix(x.copy()) >> np.uint64(32)).astype("<u4"))[: s.sketch] for x in sets]
        at = np.append(0, np.cumsum([len(x) for x in images]))
        x, y = np.triu_indices(len(sets), 1)
        near = minhash._near(np.concatenate(images), at, x, y, s)
        both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
        similar = both / (2 * size - both)
        assert near[similar >= 0.75].all()
        if 60 <= size < 64:
            assert not near[similar < 0.68].any()
    assert len(minhash._near(images[0], at[:2], x[:0], y[:0], s)) == 0


def test_pairs_right_at_the_limit(spark):
    """Three common shingles of four are 75 percent; vectors of cosine 0.9 in doubles are linked."""
    texts = ["a b c d e f g", "a b c d e f g h", "p q r s t u v w", "p q r s t u v x"]  # 3 of 4; 3 of 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.link(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    rows = [(1, [1.0, 0.0]), (2, [0.9, math.sqrt(1 - 0.81) - 1e-12]), (3, [-1.0, 0.0]), (4, [-0.8999, math.sqrt(1 - 0.8999**2)])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:5], 3 * base[5:8]])
    lists = [list(map(float, v)) for v in near] + [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], []]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(lists)], "vec_id long, embedding array<double>, n_links int")
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    want = smallest(len(lists), zip(*np.nonzero(np.triu(close, 1)), strict=True))
    found = {r.vec_id: r for r in vectors.link(df).collect()}
    links = sum(r.n_links for r in found.values())
    assert links >= 0.9 * (close.sum() - len(near))
    assert all(found[i].n_links <= close[i].sum() - 1 for i in range(len(near)))
    assert sum(found[i].component_id == want[i] for i in found) >= 0.98 * len(lists)
    assert all(found[i].n_links == 0 and found[i].kept for i in range(len(near), len(lists)))
    assert vectors.link(df.limit(0)).count() == 0


def test_vector_recall_by_plan():
    for n in (100, 10**5, 10**9):
        width, tables = vectors.plan(n, vectors.Settings())
        assert (1 - vectors.same_cell(math.sqrt(0.2), 2.0) ** width) ** tables <= 0.0201


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choices(["big", "mid", "small", None, "empty"], [70, 20, 5, 3, 2])[0]
        rows.append((i, None if source == "empty" else " ".join(["w"] * rng.randint(1, 30)), source, "old"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string").cache()


def test_mixing_keeps_everything_within_the_limit(sources):
    got = mixing.mix(sources, mixing.Settings(most_epochs=3.0))
    seen = collections.Counter(r.doc_id for r in got.select("doc_id").collect())
    assert set(seen) == set(range(900)) and max(seen.values()) <= 3
    assert got.columns == ["doc_id", "text", "source", "epoch", "block", "place"]


def test_mixing_meets_weights(sources):
    settings = mixing.Settings(most_epochs=None, entropy=0.8, budget=1.0)
    plan = mixing.plan(sources, settings).collect()
    total = sum(r.tokens for r in plan)
    share = collections.Counter()
    for r in plan:
        share[r.source] += r.tokens
    weights = {r.source: r.weight for r in plan}
    for k, w in weights.items():
        assert abs(share[k] / total - w) < 0.03
    entropy = -sum(w * math.log(w) for w in weights.values() if w)
    assert entropy == pytest.approx(0.8 * math.log(len([w for w in weights.values() if w])), abs=1e-3)


def test_mixing_is_repeatable_and_takes_empty_tables(sources):
    a, b = (sorted(map(tuple, mixing.mix(sources).select("doc_id", "epoch", "block", "place").collect())) for _ in range(2))
    assert a == b
    assert mixing.mix(sources.limit(0)).count() == 0


def fold(i):
    return zlib.crc32(str(i).encode()) % 10


TRAINED = "crc32(cast(cast(doc_id AS string) AS binary)) % 10 <> 0"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    follow = {w: rng.choices("abcdefgh", k=2) for w in "abcdefgh"}
    texts = []
    for _ in range(300):
        w = [rng.choice("abcdefgh")]
        while rng.random() < 0.95:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else f"r{rng.randrange(300)}" if rng.random() < 0.5 else rng.choice("abcdefgh"))
            if w[-1][0] == "r":
                w.append(rng.choice("abcdefgh"))
        texts.append(" ".join(w))
    texts += [None, "", "A b", "never seen words"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache(), texts


def as_tokens(texts):
    return [WORD.findall((x or "").lower()) + ["\n"] for x in texts]


def test_base_scores(spark, corpus):
    df, texts = corpus
    tokens = as_tokens(texts)
    count = collections.Counter(t for i, x in enumerate(tokens) if fold(i) for t in x)
    n, v = sum(count.values()), len(count)
    for settings in (hpylm.Settings(), hpylm.Settings(most_words=20, least_buckets=8, many=2, tokens_per_block=500)):
        model = hpylm.learn(df, TRAINED, settings)
        assert (model.plan.tokens, model.plan.words) == (n, v)
        got = {r.doc_id: r for r in hpylm.score_all(model).collect()}
        assert len(got) == len(texts)
        for i, x in enumerate(tokens):
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(x), sum(count[t] > 0 for t in x), n)
            assert got[i].base_score == pytest.approx(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x))
        held = [i for i in got if not fold(i) and i < 300]
        assert sum(got[i].score for i in held) > 0.8 * sum(got[i].base_score for i in held)  # both are below zero: bigrams help
        assert all(r.score < 0 for r in got.values())


class Restaurants:
    """A learned model's seatings, gathered from its buckets, and the predictive probabilities by their definition."""

    def __init__(self, model):
        self.model, self.plan = model, model.plan
        s = self.plan.s
        self.count, self.tables, self.sent, self.root = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
        for r in model.dealt.filter("bucket >= 0").collect():
            block = hpylm.Block(self.plan, r.bucket, bytes(r.pairs))
            for k, (t, root) in enumerate(list(block.states(model.past[:-1]))[-s.kept :]):
                for i in np.flatnonzero(block.here):
                    w, u = int(block.words[block.word[i]]), int(block.contexts[block.context[i]])
                    self.tables[k, u, w] += int(t[i])
                    self.count[k, u, w] += int(block.count[i])
                for i in np.flatnonzero(block.own_word):
                    self.root[k, int(block.words[i])] = int(root[i])
        for (k, u, w), t in self.tables.items():
            self.sent[k, w] += t
        for k, totals in enumerate(model.past[-s.kept :]):
            for w in range(self.plan.begin):
                assert self.sent[k, w] == totals.sent[w]
                self.root[k, w] = int(totals.root[w])
            assert totals.all_sent == sum(n for (j, _), n in self.sent.items() if j == k)
        self.of_context = collections.defaultdict(lambda: [0, 0])
        for (k, u, w), t in self.tables.items():
            self.of_context[k, u][0] += t
            self.of_context[k, u][1] += self.count[k, u, w]

    def code(self, word):
        data = np.frombuffer(word.encode(), np.uint8)
        h = hpylm.tokens_of(data, np.array([0, len(data)]))[0][:1] if word != "\n" else np.array([hpylm.END], np.uint64)
        return int(self.plan.codes(h)[0])

    def probability(self, w, u):
        s, v, p = self.plan.s, self.plan.words, 0.0
        for k in range(s.kept):
            sent, root = (sum(n for (j, _), n in x.items() if j == k) for x in (self.sent, self.root))
            parent = (self.sent[k, w] - s.root_discount * self.root[k, w] + (s.root_strength + s.root_discount * root) / (v + 1)) / (s.root_strength + sent)
            t, c = self.of_context[k, u]
            p += (self.count[k, u, w] - s.discount * self.tables[k, u, w] + (s.strength + s.discount * t) * parent) / (s.strength + c)
        return p / s.kept


@pytest.mark.parametrize("settings", [hpylm.Settings(least_buckets=8), hpylm.Settings(most_words=20, least_buckets=8, many=4, tokens_per_block=1000)])
def test_scores_are_those_of_the_seatings(spark, corpus, settings):
    df, texts = corpus
    model = hpylm.learn(df, TRAINED, settings)
    plain = Restaurants(model)
    assert all(1 <= plain.tables[x] <= n for x, n in plain.count.items() if n)
    want = collections.Counter((b, w) for i, x in enumerate(as_tokens(texts)) if fold(i) for b, w in zip([None, *x], x, strict=False))
    assert sum(want.values()) == model.plan.tokens
    for (b, w), n in want.items():
        u = model.plan.begin if b is None else plain.code(b)
        assert plain.count[0, u, plain.code(w)] == n
    got = {r.doc_id: r.score for r in hpylm.score_all(model).collect()}
    for i in [*range(0, 300, 15), *range(300, len(texts))]:
        x = [plain.code(w) for w in as_tokens(texts)[i]]
        assert got[i] == pytest.approx(sum(math.log10(plain.probability(w, u)) for u, w in zip([model.plan.begin, *x], x, strict=False)), abs=1e-3)
    words = {w for (_, _, w), n in plain.count.items() if n} | {1 << 61}  # and one place for unknown words
    for u in (model.plan.begin, plain.code("a"), plain.code("r7"), plain.code("nowhere")):
        assert sum(plain.probability(w, u) for w in words) == pytest.approx(1)


def plain_gibbs(train, held, s, sweeps, seed):
    """The same model with one customer at a time taken out and seated again; the mean logarithm per held-out token."""
    rng = random.Random(seed)
    vocabulary = {w for x in train for w in x}
    v = len(vocabulary)
    seats = collections.defaultdict(list)  # (context, word): customers of each table
    roots = collections.defaultdict(list)
    n_tables, n_customers = collections.Counter(), collections.Counter()
    total = [0, 0]  # the parent's customers and tables

    def parent(w):
        return (sum(roots[w]) - s.root_discount * len(roots[w]) + (s.root_strength + s.root_discount * total[1]) / (v + 1)) / (s.root_strength + total[0])

    def sit(tables, discount, new):
        weights = [n - discount for n in tables] + [new]
        i = rng.choices(range(len(weights)), weights)[0]
        if i == len(tables):
            tables.append(0)
        tables[i] += 1
        return tables[i] == 1

    def add(u, w):
        if sit(seats[u, w], s.discount, (s.strength + s.discount * n_tables[u]) * parent(w)):
            n_tables[u] += 1
            total[0] += 1
            if sit(roots[w], s.root_discount, (s.root_strength + s.root_discount * total[1]) / (v + 1)):
                total[1] += 1
        n_customers[u] += 1

    def leave(tables):
        i = rng.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    pairs = [(u, w) for x in train for u, w in zip([None, *x], x, strict=False)]
    for u, w in pairs:
        add(u, w)
    scores = []
    for sweep in range(sweeps):
        for u, w in pairs:
            n_customers[u] -= 1
            if leave(seats[u, w]):
                n_tables[u] -= 1
                total[0] -= 1
                if leave(roots[w]):
                    total[1] -= 1
            add(u, w)
        if sweep >= sweeps // 2:
            scores.append([(sum(seats[u, w]) - s.discount * len(seats[u, w]) + (s.strength + s.discount * n_tables[u]) * parent(w)) / (s.strength + n_customers[u]) for x in held for u, w in zip([None, *x], x, strict=False)])
    return float(np.log10(np.mean(scores, axis=0)).mean())


def test_scores_agree_with_a_plain_sampler(spark, corpus):
    df, texts = corpus
    tokens = as_tokens(texts)
    train, held = [x for i, x in enumerate(tokens) if fold(i)], [x for i, x in enumerate(tokens) if not fold(i)]
    plain = [plain_gibbs(train, held, hpylm.Settings(), 12, seed) for seed in (1, 2)]
    got = []
    for settings in (hpylm.Settings(), hpylm.Settings(least_buckets=3, seed=9), hpylm.Settings(most_words=20)):
        scored = [r for r in hpylm.score(df, TRAINED, settings).collect() if not fold(r.doc_id)]
        got.append(sum(r.score for r in scored) / sum(r.n_tokens for r in scored))
    assert max(got) - min(got) < 0.01  # buckets and what counts as rare change little
    assert abs(sum(plain) / 2 - got[0]) < 0.01, (plain, got)


def test_frequent_pairs_are_one_entry_a_block(spark):
    rng = random.Random(9)
    texts = [" ".join(["na"] * 40 + [f"w{rng.randrange(60)}" for _ in range(40)]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores, entries = [], []
    for many in (2, 10**9):
        model = hpylm.learn(df, "doc_id < 100", hpylm.Settings(least_buckets=8, many=many))
        scores.append(sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in hpylm.score_all(model).collect()))
        entries.append(sum(int(hpylm.unpack(bytes(r.occurrences))[1].sum()) for r in model.dealt.filter("bucket >= 0").collect()))
    for a, b in zip(*scores, strict=True):
        assert a == pytest.approx(b, abs=1e-2)
    assert entries[1] == 120 * 81 and entries[0] < entries[1] / 2


def test_language_model_takes_odd_tables(spark):
    rows = [("x", "a b", 1.0), (None, None, 2.0), ("x", "a b", 3.0), ("y", "", 4.0), ("z", "a " * 50_000, 5.0)]
    df = spark.createDataFrame(rows, "doc_id string, text string, score double")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known) for r in hpylm.score(df, "false").collect()), key=str)
    assert got == sorted([("x", 3, 0), (None, 1, 0), ("x", 3, 0), ("y", 1, 0), ("z", 50_001, 0)], key=str)
    assert hpylm.score(df.limit(0)).count() == 0
    again = hpylm.score(df)
    assert again.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert all(r.n_known == r.n_tokens and r.train_tokens == 50_009 for r in again.collect())
    assert hpylm.perplexity(again).first().perplexity > 1


def test_numbers_are_packed():
    rng = np.random.default_rng(3)
    arrays = [np.zeros(0, np.int64), rng.integers(0, 200, 50), rng.integers(0, 2**62, 7), np.array([2**16]), rng.normal(size=4).view(np.uint64)]
    for a, b in zip(arrays, hpylm.unpack(hpylm.pack(*arrays)), strict=True):
        assert (a.astype(np.uint64) == b.astype(np.uint64)).all()


def test_numbers_of_tables_are_drawn_from_their_probabilities():
    """Against the generalised Stirling numbers themselves, for few and for many customers."""
    rng = np.random.default_rng(4)
    for n, weight, p in ((6, 9.0, 0.2), (200, 40.0, 0.05), (2_000, 300.0, 0.02), (2_000, 3_000.0, 0.2), (30_000, 50.0, 0.1)):
        log = np.array([0.0])  # logarithms of the numbers of n = 1, for m = 1, 2, ...
        for k in range(1, n if n <= 2_000 else 1):
            m = np.arange(1, k + 2)
            stay = np.append(log, -np.inf) + np.log(np.maximum(k - 0.8 * m, 1e-300))
            log = np.logaddexp(np.append(-np.inf, log), stay)
        m = np.arange(1, n + 1)
        if n > 2_000:  # the limit for many more customers than tables
            m = m[:200]
            log = -np.array([math.lgamma(x) for x in m]) - (m - 1) * math.log(0.8)
        log = log + np.append(0, np.cumsum(np.log((weight + 0.8 * m[:-1]) * p)))
        chance = np.exp(log - log.max())
        chance /= chance.sum()
        mean, deviation = (chance * m).sum(), math.sqrt((chance * m**2).sum() - (chance * m).sum() ** 2)
        drawn = hpylm.seat(np.full(4_000, n), np.full(4_000, weight), 0.8, np.full(4_000, p), np.ones(4_000), 0, rng)
        assert abs(drawn.mean() - mean) < 0.1 * deviation + 0.002 * mean, (n, drawn.mean(), mean, deviation)
        assert abs(drawn.std() - deviation) < 0.1 * deviation, (n, drawn.std(), deviation)


def seated(customers, discount, strength, rng):
    """Tables of one restaurant whose customers came one by one, with a dish of its own for each."""
    tables = []
    for n in range(customers):
        weights = np.append(np.array(tables) - discount, strength + discount * len(tables))
        i = rng.choice(len(weights), p=weights / (n + strength))
        tables = [*tables, 1] if i == len(tables) else [*tables[:i], tables[i] + 1, *tables[i + 1 :]]
    return tables


def test_discounts_and_strengths_are_learned(spark, corpus):
    """Drawn anew after each sweep; the means of both levels differ from what they start with, and held-out texts get likelier."""
    df, _ = corpus
    mean = {}
    for sampled in (False, True):
        model = hpylm.learn(df, TRAINED, hpylm.Settings(sampled=sampled, least_buckets=8, most_words=50))
        drawn = [t.hyper for t in model.past]
        assert len(set(drawn)) == (len(drawn) if sampled else 1)
        assert all(0 < h.discount < 1 and 0 < h.root_discount < 1 and h.strength > 0 and h.root_strength > 0 for h in drawn)
        scored = [r for r in hpylm.score_all(model).collect() if not fold(r.doc_id)]
        mean[sampled] = sum(r.score for r in scored) / sum(r.n_tokens for r in scored)
    assert mean[True] > mean[False]


def test_discounts_and_strengths_come_from_the_seatings():
    """Restaurants with known ones: their means over draws are near, whatever they start with."""
    rng = np.random.default_rng(8)
    for discount, strength in ((0.7, 3.0), (0.3, 12.0)):
        sizes = [seated(60, discount, strength, rng) for _ in range(150)]
        tables = np.array([len(x) for x in sizes])
        one = np.ones(len(sizes))
        d, b, got = 0.5, 1.0, []
        for _ in range(30):
            # all customers of a table share its dish, so each dish has one table
            shared = hpylm.shared_seats(np.concatenate(sizes), np.ones(sum(map(len, sizes)), np.int64), d, rng)
            d, b = hpylm.draw_pair(shared, hpylm.Ladder(tables, one), int((tables - 1).sum()), hpylm.Ladder(np.full(len(sizes), 60), one), d, b, rng)
            got.append((d, b))
        d, b = np.mean(got[10:], axis=0)
        assert abs(d - discount) < 0.06 and abs(math.log(b / strength)) < 0.35, (d, b)


def test_shared_seats_are_drawn_from_the_ways_to_sit():
    """Their mean is that of the exponent of ``1 - discount`` in the generalised Stirling numbers, by a difference of their logarithms."""

    def ways(n, d):
        log = np.array([0.0])
        for k in range(1, n):
            stay = np.append(log, -np.inf) + np.log(np.maximum(k - d * np.arange(1, k + 2), 1e-300))
            log = np.logaddexp(np.append(-np.inf, log), stay)
        return log

    rng = np.random.default_rng(6)
    for d in (0.5, 0.8):
        for n, ms in ((2, (1, 2)), (6, (1, 3, 5)), (200, (3, 30, 150)), (1_500, (1, 5, 300))):
            slope = (ways(n, d + 1e-5) - ways(n, d - 1e-5)) / 2e-5
            for m in ms:
                got = hpylm.shared_seats(np.full(3_000, n), np.full(3_000, m), d, rng) / 3_000
                assert got == pytest.approx(-(1 - d) * slope[m - 1], rel=0.02, abs=0.04), (d, n, m)
