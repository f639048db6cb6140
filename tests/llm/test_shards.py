import collections
import random
import zlib

import pyarrow.parquet as pq

from tidemark.llm import shards
from tidemark.llm.queries import QUERIES

from .edge import empty, frame, rows


def check(out, docs, n=16):
    assert len(out) == len(docs)
    by_shard, places = collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        assert 0 <= r["shard"] < n and r["law"] == "bytes" and r["grown_shard"] is None
        by_shard[r["shard"]].append(r)
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    for s in by_shard.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    for r in out:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        places[t].add(r["shard"])
    assert all(len(p) == 1 for p in places.values())
    group = collections.Counter()
    for d in docs:
        group[d["text"] or ""] += len((d["text"] or "").encode()) + 1
    sums = [sum(r["size"] for r in by_shard[k]) for k in range(n)]
    return sums, max(group.values()), sum(group.values())


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{d}/documents.parquet").to_pylist()
    sums, largest, total = check(QUERIES["op8_karmarkar_karp_shards"](spark, d).collect(), docs)
    assert max(sums) - min(sums) <= max(0.002 * total / 16, largest * 0.02)


def test_edges(spark):
    docs = [{"doc_id": r[0], "text": r[1]} for r in rows()]
    check(shards.balance(frame(spark)).collect(), docs)
    assert shards.balance(empty(spark)).count() == 0


def test_difference_beats_greedy_and_keeps_every_item():
    rng = random.Random(1)
    for parts in (2, 3, 16):
        items = [(k, rng.randint(1, 10_000)) for k in range(300)]
        out = shards.difference(items, parts)
        assert sorted(out) == list(range(300)) and set(out.values()) <= set(range(parts))
        sums = [sum(s for k, s in items if out[k] == p) for p in range(parts)]
        greedy = [0] * parts
        for _, s in sorted(items, key=lambda x: -x[1]):
            greedy[greedy.index(min(greedy))] += s
        assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert shards.difference([(0, 5), (1, 4), (2, 3), (3, 3), (4, 3)], 2) and shards.difference([], 4) == {}
