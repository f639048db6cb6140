import math
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import lattice
from tidemark.llm.queries import QUERIES, VOCABULARY

from .edge import empty, frame, rows


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(VOCABULARY)


def plain(pieces, scores, word):
    """Sum over segmentations by recursion over beginnings, in exact numbers."""
    known = {p: Fraction(math.exp(s)) for p, s in zip(pieces.pieces, scores) if s > -math.inf}
    w = b" " + word
    way = [Fraction(1)] + [Fraction(0)] * len(w)
    for end in range(1, len(w) + 1):
        way[end] = sum((way[b] * known[w[b:end]] for b in range(max(0, end - 130), end) if w[b:end] in known), Fraction(0))
        # enough digits, and numbers that don't grow
        shift = max(0, way[end].denominator.bit_length() - way[end].numerator.bit_length() + 200)
        way[end] = Fraction((way[end].numerator << shift) // way[end].denominator, 1 << shift) if way[end] else way[end]
    return math.log(way[-1].numerator) - math.log(way[-1].denominator)


def random_scores(pieces, seed, groups=2):
    rng = np.random.default_rng(seed)
    s = np.log(rng.dirichlet(np.ones(len(pieces.pieces)), groups)).T
    return np.concatenate([s, np.full((1, groups), -np.inf)])


def test_forward_recursion_is_the_sum_over_segmentations(pieces):
    scores = random_scores(pieces, 0)
    words = [b"the", b"thetionerly", "é漢字ü".encode(), b"a", b"\x00\xff\x80", b"international", b"x" * 32, b"of", b"to", b"longer" * 60, b"counterterrorism", b"ab" + b"-" * 150, "漢字かな".encode() * 300, b"=" * 700]
    got = lattice.word_scores(pieces, scores, np.zeros(2), words)
    for g in range(2):
        assert np.allclose(got[:, g], [plain(pieces, scores[:, g], w) for w in words])


def test_long_words_take_seconds(pieces):
    scores = random_scores(pieces, 2, groups=5)
    word = bytes(np.random.default_rng(1).choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 1_000_000))
    began = time.monotonic()
    whole = lattice.word_scores(pieces, scores, np.zeros(5), [word])
    assert time.monotonic() - began < 40
    # a sum over cuts is below the whole, and not far
    halves = [lattice.word_scores(pieces, scores, np.zeros(5), [w]) for w in (word[:500_000], word[500_000:])]
    assert (abs(whole - sum(halves)) < 40).all()


def test_expected_counts_are_the_gradient(pieces):
    scores, words = random_scores(pieces, 1), [b"the", b"another", b"thing", b"long" * 60]
    weights = np.array([[1.0, 0], [1, 1], [0, 1], [2, 0]])
    expected = lattice.expected_counts(pieces, scores, words, weights)
    total = lambda s, g: (lattice.word_scores(pieces, s, np.zeros(2), words)[:, g] * weights[:, g]).sum()
    for g in range(2):
        for k in np.argsort(-expected[:, g])[:6]:
            up, down = scores.copy(), scores.copy()
            up[k, g] += 1e-5
            down[k, g] -= 1e-5
            assert abs((total(up, g) - total(down, g)) / 2e-5 - expected[k, g]) < 1e-3
        # each segmentation spells the words, so expected bytes are the words' bytes
        assert abs(sum(e * len(p) for e, p in zip(expected[:, g], pieces.pieces)) - sum(m * (len(w) + 1) for m, w in zip(weights[:, g], words))) < 1e-6


def test_words_that_begin_alike_share_their_work(pieces, monkeypatch):
    rng = np.random.default_rng(3)
    words = [b"inter" + bytes(rng.choice(np.frombuffer(b"aeinrst", np.uint8), 5)) for _ in range(3000)]
    weights = np.eye(4)[rng.integers(0, 4, len(words))]
    scores = random_scores(pieces, 4, groups=4)
    counted, exp = [0], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: counted.__setitem__(0, counted[0] + np.size(x)) or exp(x, *a, **k))
    got = lattice.expected_counts(pieces, scores, words, weights)
    monkeypatch.undo()
    # a way to a place is weighed once for each group that has a word through it, not for each word and group
    known = set(pieces.pieces)
    begun = [{(b" " + w)[:k] for w, own in zip(words, weights[:, g]) if own for k in range(1, len(w) + 2)} for g in range(4)]
    assert counted[0] <= sum(b[k:] in known for places in begun for b in places for k in range(len(b)))
    assert abs(sum(e * len(p) for e, p in zip(got.sum(1), pieces.pieces)) - sum(len(w) + 1 for w in words)) < 1e-6


def test_tries_give_what_words_alone_give(pieces, monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(np.frombuffer(b"abenrt-\xc3\xa9", np.uint8), n)) for n in rng.integers(1, 30, 60)]
    words += [b"responsibilities", b"responsibility", b"-" * 128, b"a" + b"-" * 70, b"n" * lattice.LONG, b"n" * (lattice.LONG + 1), words[0]]
    weights = rng.integers(0, 3, (len(words), 2)) / 2
    scores, stop = random_scores(pieces, 6), np.array([-1.0, -2.0])
    alone = sum(lattice.expected_counts(pieces, scores, [w], weights[k : k + 1]) for k, w in enumerate(words))
    exact = [[plain(pieces, scores[:, g], w) + stop[g] for g in range(2)] for w in words[::3] + words[-7:]]
    for size in (1 << 20, 100):
        monkeypatch.setattr(lattice, "TRIE", size)
        assert np.allclose(lattice.expected_counts(pieces, scores, words, weights), alone)
        assert np.allclose(lattice.word_scores(pieces, scores, stop, words[::3] + words[-7:]), exact)


def brute(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in docs if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for i, t in docs)


def listed(out):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out)


def close(a, b):
    return len(a) == len(b) and all(x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-3 for x, y in zip(a, b))


def test_query(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()]
    out = QUERIES["op1_subword_lattice"](spark, d).collect()
    assert close(listed(out), brute(docs))
    held = [r for r in out if r["held_out"]]
    score, base, n = sum(r["score"] for r in held), sum(r["base_score"] for r in held), sum(r["n_tokens"] for r in held)
    print("held out, log10 a token:", score / n, "base", base / n)
    # a thousand texts leave a quarter of the words unseen, which the base gives more than a distribution has
    assert -7 < score / n and all(r["score"] < 0 for r in out)
    # a small head sends nearly all words through the join: nothing may change
    monkeypatch.setattr(lattice, "HEAD", 100)
    monkeypatch.setattr(lattice, "STEPS", 0)
    small = QUERIES["op1_subword_lattice"](spark, d).collect()
    assert close(listed(small), brute(docs))


def test_every_step_sees_all_words(spark, pieces, monkeypatch):
    monkeypatch.setattr(lattice, "STEPS", 1)
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma betagamma " + "x" * 300)], "doc_id long, text string")
    model = lattice.learn(docs, lattice.F.lit(True), VOCABULARY)
    words = [b"alpha", b"beta", b"gamma", b"betagamma", b"x" * 300]
    once = lattice.expected_counts(pieces, *pieces.start(1)[:1], words, np.ones((5, 1)))
    scores, stop = lattice.renew(pieces, once, np.array([5.0]))
    assert np.allclose(model.scores[:-1], scores[:-1]) and np.allclose(model.stop, stop)


def test_probabilities_sum_to_at_most_one(spark, pieces):
    df = spark.createDataFrame([(k, "ab a b ab ba abb", "x" if k % 2 else None) for k in range(50)], "doc_id long, text string, lang string")
    words = ["".join(w).encode() for n in range(1, 7) for w in __import__("itertools").product("ab", repeat=n)]
    m = lattice.learn(df, lattice.F.lit(True), VOCABULARY)
    mass = np.exp(lattice.word_scores(pieces, m.scores, m.stop, words) + m.going_on()).sum(0) + np.exp(m.end())
    assert m.groups == 2 and (np.exp(m.end()) < mass).all() and (mass <= 1 + 1e-9).all()


def test_scores_are_sums_over_segmentations_and_languages(spark, pieces, monkeypatch):
    docs = [(1, "the cat and the hat", "en"), (2, "le chat et la haine", "fr"), (3, "the end of the hat", "en"), (4, "catalogue", None), (5, "", "en"), (6, "the chat, unseen words", "fr"), (7, "a" * 260 + " cat", "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    seen = {}
    plain_learn = lattice.learn
    monkeypatch.setattr(lattice, "learn", lambda *a, **k: seen.setdefault("model", plain_learn(*a, **k)))
    out = {r["doc_id"]: r for r in lattice.score_documents(d, VOCABULARY).collect()}
    m = seen["model"]
    train = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    groups = [x for x, _ in sorted(Counter(r[2] for r in train if r[2]).items(), key=lambda x: (-x[1], x[0]))] + [None] * any(r[2] is None for r in train)
    assert m.groups == len(groups)
    for i, text, _ in docs:
        total = 0.0
        for g, name in enumerate(groups):
            own = [r[1] for r in train if r[2] == name]
            tokens = sum(len(t.split()) + 1 for t in own)
            e = len(own) / tokens
            p = Fraction(len(own), len(train)) * Fraction(e)
            for w in text.lower().encode().split():
                p *= Fraction(1 - e) * Fraction(math.exp(plain(pieces, m.scores[:, g], w) + m.stop[g])) if len(w) < 200 else 1
            total += float(p)
        if i != 7:
            assert abs(out[i]["score"] - math.log10(total)) < 1e-9, i
    assert out[7]["score"] < -20


def test_edges(spark):
    data = [(r[0], r[1]) for r in rows()]
    out = lattice.score_documents(frame(spark), VOCABULARY).collect()
    assert close(listed(out), brute(data))
    assert all(math.isfinite(r["score"]) for r in out)
    same = {r["doc_id"]: r["score"] for r in out}
    assert same[2] == same[3] == same[4] == same[99]
    assert lattice.score_documents(empty(spark), VOCABULARY).count() == 0
