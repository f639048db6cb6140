import random

import pyarrow.parquet as pq

from tidemark.llm import minhash
from tidemark.llm.queries import QUERIES

from .edge import empty, frame, rows


def sets_of(docs, width=5):
    out = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute(docs, percent=85):
    sets = sets_of(docs)
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    owners = {}
    for k, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(k)
    pairs = {(a, b) for o in owners.values() for i, a in enumerate(o) for b in o[i + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[find(b)] = find(a)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k), []).append(docs[k][0])
    first = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(docs[k][0]), len(sets[k]), str(first[find(k)])) for k in range(len(docs)))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def near_copies(n, words, seed, spread=8):
    """A chain of texts around one base, most of them a few edits away."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randint(0, spread)):
            t[rng.randrange(words)] = f"e{rng.randint(0, 99)}"
        out.append((k, " ".join(t)))
    return out


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()]
    df = QUERIES["op9_minhash_coordinate_join"](spark, d)
    assert got(df) == brute(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect())


def test_large_groups_are_dealt_in_chunks_and_blocks(spark, monkeypatch):
    docs = near_copies(150, 60, 1) + [(1000 + k, t) for k, t in near_copies(90, 40, 2, 4)] + [(5000 + k, f"shared passage of words that many texts have in common and more {k} {k * 7} {k * k} {k + 5} tail") for k in range(120)]
    monkeypatch.setattr(minhash, "CHUNK", 16)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(minhash.components_by_document(df)) == brute(docs)


def test_links_between_groups_of_two_representatives_are_found(spark, monkeypatch):
    # a chain: neighbours are linked, ends aren't, and any few classes stand for a part of it only
    monkeypatch.setattr(minhash, "CHUNK", 16)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(base[2 * k : 2 * k + 120])) for k in range(140)]
    random.Random(3).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = got(minhash.components_by_document(df, percent=85))
    assert found == brute(docs, 85) and {c for _, _, c in found} == {"0"}


def test_a_large_group_of_near_copies_isn_t_compared_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 32)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    docs = near_copies(1500, 200, 5, 2)
    dealt = []
    plain = minhash.deal
    monkeypatch.setattr(minhash, "deal", lambda *a, **k: (dealt.append(d := plain(*a, **k)), d)[1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {c for _, _, c in got(minhash.components_by_document(df))} == {"0"}
    # rows that are dealt again: pairs of chunks would be 1500 * 47 for every long list
    assert sum(d.count() for d in dealt) < 1500 * 47


def test_edges(spark):
    data = [(r[0], r[1]) for r in rows()]
    assert got(minhash.components_by_document(frame(spark))) == brute(data)
    assert minhash.components_by_document(empty(spark)).count() == 0
    kept = minhash.drop_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("the first short text with a few words in it") == 1 and texts.count(None) == 2 and texts.count("") == 1
    assert minhash.drop_near_duplicates(empty(spark)).count() == 0


def test_matches_needed():
    t = minhash.matches_needed(85)
    assert 30 < t < 45 and minhash.matches_needed(100) == 64 and minhash.matches_needed(80) < t
