import collections
import random

import pyarrow.parquet as pq

from tidemark.llm import mixing
from tidemark.llm.queries import QUERIES

from .edge import empty, frame, rows


def water(sizes, weights, share, cap):
    """Brute force: give out by weight, close what is above its cap, again."""
    budget, full = sum(sizes) * share, set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = budget - sum(cap * sizes[i] for i in full)
        weight = sum(weights[i] for i in open_)
        target = [cap * sizes[i] if i in full else left * weights[i] / weight for i in range(len(sizes))]
        over = [i for i in open_ if target[i] > cap * sizes[i] + 1e-9]
        if not over:
            return target
        full |= set(over)
        if len(full) == len(sizes):
            return [cap * s for s in sizes]


def check(out, docs, source=lambda r: r["source"]):
    size = collections.Counter()
    for r in docs:
        size[source(r)] += len((r["text"] or "").encode().split())
    order = sorted((s for s in size if s is not None), key=lambda s: s) + [None] * (None in size)
    target = dict(zip(order, water([size[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2)))
    taken = collections.Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1


def test_query(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    out = QUERIES["op5_mix_sources"](spark, sf_dir).collect()
    assert len(out) == len(docs)
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in docs}
    assert all(r["size"] == words[r["doc_id"]] for r in out)
    check(out, docs)
    again = QUERIES["op5_mix_sources"](spark, sf_dir).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_edges(spark):
    docs = [{"source": r[3], "text": r[1]} for r in rows()]
    out = mixing.mix_sources(frame(spark)).collect()
    assert len(out) == len(docs)
    check(out, docs)
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_water_fill_random(spark):
    rng = random.Random(3)
    for _ in range(3):
        sizes = [rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(0, 9) for _ in range(7)]
        weights = [rng.randint(1, 5) for _ in sizes]
        df = spark.createDataFrame([(str(i), s, float(w), i) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double, rank int")
        for share in (0.3, 1.5, 2.5):
            got = {r["source"]: r["target"] for r in mixing.water_fill(df, share, 2.0).collect()}
            want = water(sizes, weights, share, 2)
            assert all(abs(got[str(i)] - want[i]) <= 1e-6 * max(1, want[i]) for i in range(len(sizes)))


def test_the_mixture_has_the_words_that_the_plan_takes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.apply_mix(docs)
    assert mixed.schema == docs.schema
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert all(got[k] == v for k, v in plan.items())
    assert mixing.apply_mix(frame(spark)).columns == frame(spark).columns
    assert mixing.apply_mix(empty(spark)).count() == 0


def test_a_cut_text_is_a_beginning_of_the_text(spark):
    rng = __import__("random").Random(2)
    text = lambda: "".join(rng.choice(["a", "bc", "é", "漢字"]) + rng.choice([" ", "\n", "\t\n  ", "\u00a0"]) for _ in range(rng.randint(5, 60)))
    rows = [(k, rng.choice(["", "  \n"]) + text(), f"s{k % 6}", 0) for k in range(60)]
    rows += [(7, "another text under an id that is taken", "s1", 0), (8, rows[8][1], "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    texts = collections.defaultdict(set)
    for i, t, s, _ in rows:
        texts[i, s].add(t)
    cut = 0
    for r in mixing.apply_mix(docs).collect():
        whole = [t for t in texts[r["doc_id"], r["source"]] if t.startswith(r["text"])]
        assert whole
        if r["text"] not in whole:
            cut += 1
            assert r["n_chars"] == len(r["text"]) and not r["text"][-1].isspace() or r["text"].endswith("\u00a0")
    assert cut
    taken = sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    assert sum(len(r["text"].encode().split()) for r in mixing.apply_mix(docs).collect()) == taken
