import ipaddress
import random
import re
import time

import pyarrow.parquet as pq
import regex
from pyspark.sql import functions as F

from tidemark.llm import surrogates
from tidemark.llm.queries import QUERIES

from .edge import empty, frame, rows

PYTHON = {"email": r"[\w%+-]+(?:\.[\w%+-]+)*@(?:[\w-]+\.)+[^\W\d_]{2,}", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", "card": r"(?<!\w)\d{16}(?!\w)"}


def real(text):
    return {(k, m.lower()) for k, p in PYTHON.items() for m in re.findall(p, text or "")}


def luhn(digits):
    return sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(digits[::-1], 1) if True) if False else sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    out = {r["doc_id"]: r for r in QUERIES["op4_keyed_surrogates"](spark, d).collect()}
    assert out.keys() == docs.keys()
    everything = set().union(*map(real, docs.values()))
    to, seen = {}, 0
    for i, text in docs.items():
        own = real(text)
        if not own:
            assert out[i]["text"] == text and out[i]["n_entities"] == 0
            continue
        assert not real(out[i]["text"]) & everything
        for kind, p in PYTHON.items():
            old, new = re.findall(p, text), re.findall(p, out[i]["text"])
            assert len(old) == len(new), (i, kind, old, new)
            for a, b in zip(old, new):
                seen += 1
                assert to.setdefault((kind, a.lower()), b.lower()) == b.lower()
                if kind in ("card", "phone"):
                    assert re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b)
                if kind == "card":
                    assert luhn(a) == luhn(b)
    assert seen > 20 and len(set(to.values())) == len(to)


def run(spark, texts, key="k"):
    return [r["text"] for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), key).orderBy("doc_id").collect()]


def test_formats_scripts_genders_and_coreference(spark):
    a, b, c, d, e = run(spark, ["Mrs Anna Smith met Mr. Karl Jones, then Mrs Anna Smith left.", "Г-н Иван Петров и Г-жа Анна Петрова", "Mail A.B@c.example.org or a.b@C.example.org now", "4111-1111-1111-1111 and 4111111111111111; +49 30 123456; 078-05-1120", "version 1.2.3 on 2024-01-01 costs 12345.67"])
    m = re.fullmatch(r"(Mrs (\w+) \w+) met Mr\. (\w+) \w+, then (Mrs \w+ \w+) left\.", a)
    assert m and m[1] == m[4] and m[2] in surrogates.GIVEN["latin", "f"] and m[3] in surrogates.GIVEN["latin", "m"] and "Smith" not in a
    m = re.fullmatch(r"Г-н (\w+) \w+ и Г-жа (\w+) \w+", b)
    assert m and m[1] in surrogates.GIVEN["cyrillic", "m"] and m[2] in surrogates.GIVEN["cyrillic", "f"]
    m = re.fullmatch(r"Mail (\S+) or (\S+) now", c)
    assert m and m[1] == m[2] and m[1].endswith(".org") and "c.example" not in c
    m = re.fullmatch(r"(\d{4}-\d{4}-\d{4}-\d{4}) and (\d{16}); (\+49 \d\d \d{6}); (\d{3}-\d\d-\d{4})", d)
    assert m and m[1].replace("-", "") == m[2] and luhn(m[2]) and m[2] != "4111111111111111"
    assert e == "version 1.2.3 on 2024-01-01 costs 12345.67"
    assert run(spark, ["x a@b.example.com"], "k") == run(spark, ["x a@b.example.com"], "k") != run(spark, ["x a@b.example.com"], "other")


def python_spans(text):
    """The patterns in the syntax of another engine: every match by its own search, without a hint, from left to right."""
    return [m.span() for m in regex.finditer(surrogates.PATTERN.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"), text)]


def test_long_words_and_chains_end_soon_and_break_nothing(spark):
    began = time.monotonic()
    chains = ["a." * 20_000 + "x 123@", "a." * 20_000 + "b@c.example.com", "x" * 1_000_000 + " 123", "a@" * 100_000 + "123", "x@" + "a." * 200_000 + "1", "a-" * 300_000 + "@ 123", "1" * 400_000, "+1" * 200_000, "ab:" * 100_000 + "::", "Mr. " + "A" + "a" * 500_000, "AB12" * 100_000, "." * 300_000 + "@ 123"]
    out = run(spark, chains)
    assert time.monotonic() - began < 60
    kept = [k for k, (a, b) in enumerate(zip(chains, out)) if a == b]
    assert kept == [0, 2, 3, 4, 5, 6, 7, 8, 10, 11]
    assert "c.example.com" not in out[1] and out[1].endswith(".com") and out[9].startswith("Mr. ")


def test_one_entity_has_one_surrogate_in_all_spellings(spark):
    a, b, c, d, e = run(spark, ["+1 555 123 4567 or +15551234567 or +1-555-123-4567", "Mr. Alex Smith, that is Mr. Smith, and Mr Alex Smith", "Mrs. Alex Smith and Mr. Karl Smith and Mr. Alex Jones", "x.y@one.example.com z@ONE.example.com X.Y@one.example.com q@two.example.com", "3782 822463 10005 and 378282246310005, GB82 WEST 1234 5698 7654 32, DE89370400440532013000, XX11 2222 3333 4444, 2001:0db8:85a3:0000:0000:8a2e:0370:7334 fe80::1ff:fe23:4567:890a"])
    numbers = [re.sub(r"\D", "", x) for x in a.split(" or ")]
    assert len(set(numbers)) == 1 and numbers[0].startswith("1") and numbers[0] != "15551234567"
    m = re.fullmatch(r"Mr\. (\w+) (\w+), that is Mr\. (\w+), and Mr (\w+) (\w+)", b)
    assert m and m[2] == m[3] == m[5] and m[1] == m[4]
    n = re.fullmatch(r"Mrs\. (\w+) (\w+) and Mr\. ([\w-]+) (\w+) and Mr\. (\w+) (\w+)", c)
    assert n and n[2] == n[4] == m[2] and n[5] == m[1] and n[6] != m[2] and len({n[1], n[3], m[1]}) == 3
    x, z, again, q = d.split()
    assert x == again and x.split("@")[1] == z.split("@")[1] != q.split("@")[1] and x.split("@")[0] != z.split("@")[0]
    card, same, british, german, other, six, short = re.fullmatch(r"(\d{4} \d{6} \d{5}) and (\d{15}), (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d), (DE\d{20}), (XX11 2222 3333 4444), (\S+) (\S+)", e).groups()
    assert card.replace(" ", "") == same != "378282246310005" and luhn(same) and same.startswith("37")
    for account in (british, german):
        bare = account.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert ipaddress.ip_address(six) and ipaddress.ip_address(short) and six != short


def test_hint_and_other_engine_agree_on_random_texts(spark):
    rng = random.Random(11)
    pieces = ["+", "4", "49", "123", "12", ".", "-", " ", " ", "@", "a", "Ab", "b.c", "(", ")", "(30)", "Mr", "Mrs. ", "Herr ", "Anna", "Smith", "AB12", "1234", ":", "::", "fe80", "é", "Г-н ", "Иван", "x@y.de", "10.0.0.1", "78-05-", "GB82WEST12345698765432"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.size(surrogates.found(F.col("t"))).alias("hinted"), F.size(F.regexp_extract_all("t", F.lit(surrogates.PATTERN), F.lit(0))).alias("whole")).collect()
    assert [texts[r["i"]] for r in rows if r["hinted"] != r["whole"]] == []
    differ = [(texts[r["i"]], r["whole"]) for r in rows if r["whole"] != len(python_spans(texts[r["i"]]))]
    assert differ == [] and sum(r["whole"] for r in rows) > 1000


def test_no_match_fails_the_hint(spark):
    numbers = ["+45 12 34 56 78", "+47 22 12 34 56", "+33 61 23 45 67", "+49 30 12 34 56"]
    others = ["a@b.io", "1.2.3.4", "1234 5678 9012 3456", "123-45-6789", "(12) 345 678", "+1 (12) 345-6789", "123-456-7890", "123.456.7890"]
    names = [f"{title} Xu Yo" for title in "Mr Mrs Ms Miss Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Г-н Г-жа".split()]
    found = [*numbers, *others, *names]
    out = surrogates.replace(spark.createDataFrame([(k, f"x {m} y") for k, m in enumerate(found)], "doc_id long, text string").coalesce(1), "k").collect()
    assert [(r["doc_id"], r["n_entities"]) for r in out if r["n_entities"] != 1 or found[r["doc_id"]] in r["text"]] == []
    # the same number has the same surrogate in a text that has more
    alone, beside = run(spark, [f"x {numbers[0]} y", f"x {numbers[0]} y 12345"])
    assert f"{alone} 12345" == beside


def test_collisions_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", {"latin": ["ab", "cd"], "cyrillic": ["аб"]})
    texts = [f"Herr {c}{v}r came" for c in "BDFGKLMNPRST" for v in "ae"][:10]
    for most in (20_000, 0):  # broadcast, shuffled
        monkeypatch.setattr(surrogates, "MOST_BROADCAST", most)
        out = run(spark, [*texts, *texts])
        assert len(set(out)) == 10 and out[:10] == out[10:]


def test_edges(spark):
    data = rows()
    out = surrogates.replace(frame(spark), "k").collect()
    assert len(out) == len(data)
    assert sorted(r["text"] is None for r in out) == sorted(r[1] is None for r in data)
    assert not any("a.b@c.example.com" in (r["text"] or "") or "555-2115" in (r["text"] or "") for r in out)
    same = {r[1] for r in data if r[0] != 9}
    assert all(r["text"] in same for r in out if r["doc_id"] != 9)
    assert surrogates.replace(empty(spark), "k").count() == 0
