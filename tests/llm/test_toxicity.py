from collections import Counter

import numpy as np
import pytest

from tidemark.llm import toxicity
from tidemark.llm.common import read
from tidemark.llm.queries import QUERIES

from .edge import empty, frame, rows


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    values, inverse, counts = np.unique(score[order], return_inverse=True, return_counts=True)
    ranks[order] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    one = label == 1
    return (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = {r["doc_id"]: r for r in QUERIES["op3_block_max_neighbours"](spark, d).collect()}
    assert len(out) == read(spark, d, "documents").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [(out[r["doc_id"]], r["toxic"]) for r in read(spark, d, "labels").collect() if out[r["doc_id"]]["held_out"]]
    score, label = np.array([r["score"] for r, _ in held]), np.array([t for _, t in held])
    hits = np.mean((score >= 0.5) == label)
    print("with neighbours", np.mean([r["evidence"] != "" for r in out.values()]), "held out", len(held), "accuracy", hits, "auc", auc(score, label), "recall", (score[label == 1] >= 0.5).mean(), "false", (score[label == 0] >= 0.5).mean())
    assert hits > 0.97 and auc(score, label) > 0.95 and (score[label == 0] >= 0.5).mean() < 0.01
    assert np.mean((score - label) ** 2) < 0.03


def test_block_max_finds_the_same_neighbours_as_brute_force():
    rng = np.random.default_rng(3)
    n, terms = 500, 60
    weight = np.where(np.arange(terms) < 50, 0.3, 3.0) * (rng.random(terms) + 0.5)
    # all share many light terms, and runs of them a heavy one
    docs = [np.append(rng.choice(50, rng.integers(1, 8), False), [50 + k * 10 // n] if k % 5 else []).astype(np.int64) for k in range(n)]
    docs = [(np.sort(d), rng.integers(1, 5, len(d))) for d in docs]
    index = toxicity.Index.of([str(k) for k in range(terms)], weight, rng.integers(0, 2, n), np.ones(n), list(range(n)), docs)
    dense = np.zeros((n, terms))
    for k, d in enumerate(docs):
        t, w = toxicity.vector(weight, *d)
        dense[k, t] = w
    read, whole = [], 0

    def reading(terms, q, blocks, plain=index.read):
        read.append(int((np.isin(index.terms, terms) & (True if blocks is None else np.isin(index.docs // toxicity.BLOCK, blocks))).sum()))
        return plain(terms, q, blocks)

    index.read = reading
    for k in range(0, n, 7):
        exact = dense @ dense[k]
        t, w = toxicity.vector(weight, *docs[k])
        best, near = index.nearest(t, w, k=10)
        assert np.allclose(near, np.sort(exact)[::-1][: len(near)]) and np.allclose(exact[best], near) and len(near) == min(10, (exact > 0).sum())
        without, _ = index.nearest(t, w, k=10, skip=int(best[0]))
        assert best[0] not in without
        whole += 2 * int(np.isin(index.terms, t).sum())
    assert sum(read) < 0.7 * whole  # slices of hopeless blocks aren't read


def plain_scores(docs, labels):
    """The same by dense vectors and full sorting, from the texts alone."""
    import re
    import zlib

    words = lambda t: [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x).lower() for x in (t or "").split()) if w]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = sorted(i for i in labels if not held(i))
    texts = dict(docs)
    vocabulary = {w: k for k, w in enumerate(sorted({w for i in ids for w in words(texts[i])}))}
    df = Counter(w for _, t in docs for w in set(words(t)))
    y = np.array([labels[i] for i in ids])
    has = np.zeros((len(ids), len(vocabulary)))
    for r, i in enumerate(ids):
        has[r, [vocabulary[w] for w in set(words(texts[i]))]] = 1
    p1, p0, p = has[y == 1].mean(0), has[y == 0].mean(0), has.mean(0)
    z = abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-6) * (1 / (y == 1).sum() + 1 / (y == 0).sum()))
    weight = np.array([np.log((2 + len(docs)) / (1 + df[w])) for w in vocabulary]) * (0.2 + np.clip((z - 4) / 4, 0, 1))

    def vector(t):
        v = np.zeros(len(vocabulary))
        for w, n in Counter(words(t)).items():
            if w in vocabulary:
                v[vocabulary[w]] = (1 + np.log(n)) * weight[vocabulary[w]]
        return v / (np.linalg.norm(v) or 1)

    x = np.array([vector(texts[i]) for i in ids])

    def vote(v, skip=None):
        s = x @ v
        if skip is not None:
            s[skip] = 0
        near = np.argsort(-s, kind="stable")[:15]
        g = s[near] ** 2
        return (g * y[near]).sum() / g.sum() if g.sum() else None

    votes = np.array([v if (v := vote(x[k], k)) is not None else y.mean() for k in range(len(ids))])
    a, b = toxicity.calibrate(votes, y.astype(float), np.ones(len(ids)))
    return {i: 1 / (1 + np.exp(-(a * v + b))) if (v := vote(vector(t))) is not None else y.mean() for i, t in docs}


def test_scores_are_those_of_a_plain_version(spark):
    rng = np.random.default_rng(5)
    word = [f"w{k}" for k in range(80)]
    docs, labels = [], {}
    for k in range(300):
        own = [word[int(i)] for i in rng.integers(0, 80, rng.integers(0, 40))]
        if k % 6 == 0:
            own += ["Awful!", "(dreadful)"][: 1 + k % 2]
        docs.append((k, " ".join(own)))
        if k % 2 == 0:
            labels[k] = int(k % 6 == 0)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.score(d, toxicity.learn(d, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))).collect()}
    want = plain_scores(docs, labels)
    # equal cosines may be cut off in another order among the nearest
    assert np.mean([abs(out[i]["score"] - want[i]) < 1e-9 for i, _ in docs]) > 0.97
    assert np.mean([(out[i]["evidence"] != "") == bool(t) for i, t in docs]) > 0.95


@pytest.mark.parametrize("marks", [[], [(0, 1)], [(0, 0), (5, 1), (5, 1), (6, None), (None, 1), (9999, 1)]])
def test_edges(spark, marks):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    index = toxicity.learn(frame(spark), labels)
    out = toxicity.score(frame(spark), index).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty(spark), index).count() == 0
    assert toxicity.drop_toxic(frame(spark), index).schema == frame(spark).schema
    if not marks:
        assert all(r["score"] == 0 for r in out)
    assert toxicity.score(empty(spark), toxicity.learn(empty(spark), labels)).count() == 0
