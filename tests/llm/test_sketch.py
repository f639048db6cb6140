import hashlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import sketch
from tidemark.llm.queries import QUERIES

from .edge import empty, frame, rows


def sets(text):
    w = text.lower().strip(" \t\n\x0b\x0c\r")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def edited(text, after):
    m = len(text) // 4
    return text[: len(text) - m] + after[:m]


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{d}/documents.parquet").to_pylist())
    got = {r["doc_id"]: r for r in QUERIES["op7_bottom_k_sketch"](spark, d).collect()}
    assert len(got) == len(docs)
    by_text, wrong = {}, 0.0
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        e, r = edited(text, after), got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for value, other in ((r["near_edited"], e), (r["near_next"], after)):
            a, b = sets(text), sets(other)
            exact = alike(a, b)
            assert abs(value - exact) < (1e-9 if len(a | b) <= sketch.K else 0.15), (i, value, exact)
            wrong += (value - exact) ** 2
    assert (wrong / len(docs) / 2) ** 0.5 < 0.02


def test_parts_merge_into_the_whole(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(900)), " ".join(f"w{k}" for k in range(450, 1500)))], "k int, a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, "a", "x"), "b", "y")
    df = df.withColumn("m", sketch.merge(F.col("x"), F.col("y")))
    r = df.select("m", sketch.resemblance(F.col("x"), F.col("y"), F.col("m")).alias("j"), sketch.containment(F.col("x"), F.col("y"), F.col("m")).alias("c"), sketch.distinct_shingles(F.col("x")).alias("n"), "x", "y").first()
    assert r["m"] == sorted(set(r["x"]) | set(r["y"]))[: sketch.K]
    assert abs(r["j"] - 446 / 1496) < 0.09 and abs(r["c"] - 446 / 896) < 0.15 and abs(r["n"] - 896) < 180


def test_ranges_and_edges(spark, monkeypatch):
    monkeypatch.setattr(sketch, "ROWS_A_RANGE", 3)
    data = rows()
    out = sketch.fingerprints(frame(spark)).collect()
    assert len(out) == len(data)
    texts = sorted(((r[0] is None, r[0] or 0), r[1] or "") for r in data)
    ids = [k for k, _ in texts]
    seen = {}
    for k, (key, t) in enumerate(texts):
        seen.setdefault((None if key[0] else key[1], len(t)), set()).add(hashlib.sha256(edited(t, texts[(k + 1) % len(texts)][1]).encode()).hexdigest())
    for r in out:
        if ids.count((r["doc_id"] is None, r["doc_id"] or 0)) == 1 and r["doc_id"] not in (98,):
            assert r["edited_sha256"] in seen[r["doc_id"], r["n_chars"]]
    assert sketch.fingerprints(empty(spark)).count() == 0
    one = sketch.fingerprints(frame(spark, data[:1])).first()
    assert one["near_next"] == 1.0


def test_ids_of_any_type_have_their_successor(spark, monkeypatch):
    monkeypatch.setattr(sketch, "ROWS_A_RANGE", 7)
    texts = [f"text {k} of some words {k * k}" for k in range(200)]
    names = {"string": [f"doc-{k:06d}" for k in range(200)], "double": [k * 0.5 - 3 for k in range(200)], "date": None}
    for kind in names:
        ids = "date_add(date'1999-01-01', cast(id as int))" if kind == "date" else "doc_id"
        df = spark.createDataFrame([(k, names[kind][k] if names[kind] else None, t) for k, t in enumerate(texts)], f"id long, doc_id {kind}, text string").selectExpr(f"{ids} as doc_id", "text", "id").repartition(4)
        ranges = sketch.with_range(df, "doc_id").groupBy("__range").count().collect()
        assert len(ranges) > 10 and max(r["count"] for r in ranges) < 40
        out = {r["doc_id"]: r["edited_sha256"] for r in sketch.fingerprints(df).collect()}
        for k, i in enumerate(r["doc_id"] for r in df.orderBy("id").collect()):
            assert out[i] == hashlib.sha256(edited(texts[k], texts[(k + 1) % 200]).encode()).hexdigest()
