import collections
import hashlib
import random
import re
import string

import pyarrow.parquet as pq

from tidemark.llm import secrets
from tidemark.llm.queries import QUERIES

from .edge import empty, frame, rows


def plain(text):
    """The fixed patterns, by walking from match to match."""
    out = []
    for number, (pattern, group, least) in enumerate([(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]):
        at, p = 0, re.compile(pattern)
        while m := p.search(text, at):
            if len(m.group(group)) >= least:
                out.append((m.start(), number, m.end()))
            at = m.end()
    return sorted(out)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def check(out, docs):
    assert len(out) == len(docs)
    text = {i: t or "" for i, t in docs}
    for r in out:
        want = plain(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        own = r["spans"].split(",") if r["spans"] else []
        assert [s for s in own if not s.startswith("format")] == (listed(want).split(",") if want else [])
        assert own == sorted(own, key=lambda s: (int(s.split(":")[1]), ("assign", "access", "hex", "format").index(s.split(":")[0])))
    return {r["doc_id"]: r for r in out}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()]
    check(QUERIES["op2_grammar_secrets"](spark, d).collect(), docs)


def test_learned_formats_find_what_patterns_miss_and_leave_prose_alone(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice(["th", "er", "an", "in", "on", "re", "tion", "ment"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    key = lambda: "sk_" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24))
    docs, planted = [], {}
    for k in range(600):
        w = [rng.choice(words) for _ in range(40)]
        if k % 3 == 0:
            w[5] = f'token = "{key()}"'
        elif k % 3 == 1:
            planted[k] = w[7] = key()
        docs.append((k, " ".join(w)))
    out = check(secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    found = sum(f"format:{t.index(planted[k])}:{t.index(planted[k]) + len(planted[k])}" in out[k]["spans"] for k, t in docs if k in planted)
    assert found >= 0.95 * len(planted)
    assert sum(out[k]["n_format"] for k, _ in docs if k not in planted) <= 2


def test_automata_keep_lengths_prefixes_and_alphabets():
    rng = random.Random(3)
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    fixed = secrets.Automaton(collections.Counter(draw("0123456789abcdef", 40) for _ in range(130)))
    assert fixed.states == 41  # one for each length
    own = fixed.score(draw("0123456789abcdef", 40))
    assert own > max(fixed.score(draw("0123456789abcdef", n)) for n in (38, 39, 41, 60)) + 4 and own > fixed.score(draw("ghijklmnop", 40)) + 100
    loose = secrets.Automaton(collections.Counter(draw("0123456789abcdef", 16 + min(int(rng.expovariate(0.25)), 100)) for _ in range(2000)))
    assert 16 < loose.states < 60  # no end before 16, a loop behind
    two = secrets.Automaton(collections.Counter([f"sk_{draw(string.ascii_letters, 20)}" for _ in range(300)] + [f"1/{draw(string.digits, 12)}" for _ in range(300)]))
    assert min(two.score("sk_" + draw(string.ascii_letters, 20)) for _ in range(20)) > two.score("sk_" + draw(string.digits, 20)) + 20 and two.score("1/" + draw(string.digits, 12)) > two.score("1/" + draw(string.digits, 20)) + 20


def test_all_candidates_are_scored_over_their_whole_length(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "on", "re", "tion", "ment"]) for _ in range(rng.randint(1, 7)))
    letters = lambda n: "".join(rng.choice(string.ascii_letters) for _ in range(n))
    docs = [(k, " ".join(word() if j != 9 else f"token={letters(rng.choice([12, 20, 32]))}" for j in range(60)) + f" {1900 + k} {k}.5 {k * 977}") for k in range(400)]
    # without a digit, of 12 characters, behind a long path, beside a fixed pattern
    bare, short, tail, beside = letters(32), letters(12), letters(20), letters(20)
    path = "/".join(word() for _ in range(40))
    odd = {1000: f"x {bare} y", 1001: f"x {short} y", 1002: f"x {path}/{tail} y", 1003: f"{beside}/0123456789abcdef0123 y", 1004: f"x {path} 2024-01-01 1234567890123 {'-' * 40} {'z' * 1_000_000}"}
    wanted = {1000: bare, 1001: short, 1002: tail, 1003: beside}
    docs += list(odd.items())
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = check(secrets.scan(d).collect(), docs)
    for k, value in wanted.items():
        a = odd[k].index(value)
        spans = [tuple(map(int, x.split(":")[1:])) for x in out[k]["spans"].split(",") if x.startswith("format")]
        assert len(spans) == 1 and spans[0][0] <= a and a + len(value) - 1 <= spans[0][1] <= a + len(value) + 1, (k, spans)
    assert out[1004]["n_format"] == 0 and sum(out[k]["n_format"] for k in range(400)) <= 2


def test_bytes_that_are_no_text_are_scanned_and_redacted(spark):
    d = spark.createDataFrame([(1, bytearray(b"\xff\xfe plain")), (2, bytearray(b"\xffpassword = abcdefabcdef0123 \xfe")), (3, None)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    assert {r["doc_id"]: r["n_assign"] for r in secrets.scan(d).collect()} == {1: 0, 2: 1, 3: 0}
    out = {r["doc_id"]: r["b"] for r in secrets.redact(d).selectExpr("doc_id", "cast(text as binary) as b").collect()}
    assert bytes(out[1]) == b"\xff\xfe plain" and b"abcdef" not in out[2] and b"[secret]" in out[2] and out[3] is None


def test_automaton_merges_states_and_ranks_its_own_format():
    rng = random.Random(1)
    own = collections.Counter("AB-" + "".join(rng.choice("0123456789") for _ in range(rng.randint(6, 12))) for _ in range(800))
    a = secrets.Automaton(own)
    assert a.states < 40
    assert min(a.score("AB-" + "".join(rng.choice("0123456789") for _ in range(8))) for _ in range(50)) > max(a.score(w) for w in ("AB-ABCDEFGH", "ZZ-12345678", "hello-world"))


def test_redaction_and_edges(spark):
    data = [(r[0], r[1]) for r in rows()]
    out = secrets.scan(frame(spark)).collect()
    assert len(out) == len(data)
    check([r for r in out if r["doc_id"] is not None], [x for x in data if x[0] is not None])
    assert secrets.scan(empty(spark)).count() == 0
    cut = secrets.redact(frame(spark))
    assert cut.schema == frame(spark).schema
    texts = [r["text"] for r in cut.collect()]
    assert sum((collections.Counter(texts) - collections.Counter(t for _, t in data)).values()) == 1 and not any("abcdef0123456789abcdef" in (t or "") or "AKIAABCD" in (t or "") for t in texts)
    assert secrets.redact(empty(spark)).count() == 0
