import hashlib
import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.queries import QUERIES, VOCABULARY

from .edge import empty, frame, rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_words_match_the_library(library):
    e = bpe.PrefixEncoder(VOCABULARY)
    rng = random.Random(5)
    texts = ["aaaaaaaaaaaaaaa", " antidisestablishmentarianism", "'s'lls", "\n\n  \n x", "==========", "Ünïcödé 漢字漢字", "\x00\x01", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "é"]
    texts += ["".join(rng.choice("aAbe  tTh'0129.,-=\né漢🎉") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        got = e.encode(t)
        assert got == library.encode(t, add_special_tokens=False).ids, t
        assert e.decode(got) == t.encode()


def test_query_matches_the_library_on_whole_texts(spark, library, sf_dir):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op6_bpe_prefix_trie"](spark, sf_dir).collect()}
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r["doc_id"]] == expected(library, r["text"])


def test_edges(spark, library):
    got = bpe.encode_documents(frame(spark), VOCABULARY, with_ids=True).collect()
    want = sorted((str(r[0]), *expected(library, r[1])) for r in rows())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe.encode_documents(empty(spark), VOCABULARY).count() == 0


def test_known_words_are_bounded(library):
    e = bpe.PrefixEncoder(VOCABULARY, keep=10)
    for k in range(5):
        e.learn({f"w{k}{i}" for i in range(8)})
        assert len(e.known) <= 10
