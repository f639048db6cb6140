import collections
import hashlib

import corpus_pipeline
from tidemark.llm import mixing, toxicity
from tidemark.llm.common import read, table
from tokenizers import Tokenizer

from tidemark.llm.queries import VOCABULARY

from .edge import frame
from .test_minhash import brute
from .test_secrets import plain


def test_every_stage_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    first = docs = read(spark, d, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = table(stage(spark, docs, d), name)
        after = docs.collect()
        if name != "encoding":
            assert docs.columns == first.columns
        kept[name] = len(after)
        if name == "toxicity":
            score = {r["doc_id"]: r["predicted"] for r in toxicity.score(first, toxicity.learn(first, read(spark, d, "labels"))).collect()}
            assert sorted(after) == sorted(r for r in before if not score[r["doc_id"]])
        elif name == "near_duplicates":
            groups = brute([(r["doc_id"], r["text"]) for r in before], 80)
            assert sorted(r["doc_id"] for r in after) == sorted(int(i) for i, _, first_id in groups if i == first_id)
        elif name == "secrets":
            text = {r["doc_id"]: r["text"] for r in after}
            assert len(after) == len(before)
            for r in before:
                if not plain(r["text"]):
                    assert text[r["doc_id"]] == r["text"]
                else:
                    assert "[secret]" in text[r["doc_id"]] and not plain(text[r["doc_id"]])
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(spark.createDataFrame(before, first.schema)).collect()}
            got = collections.Counter()
            for r in after:
                got[r["doc_id"]] += len(r["text"].encode().split())
            assert all(got[k] == v for k, v in taken.items())
        else:
            library = Tokenizer.from_file(VOCABULARY)
            want = collections.Counter()
            for r in before:
                ids = library.encode(r["text"], add_special_tokens=False).ids
                want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
            assert want == collections.Counter(map(tuple, after))
    assert kept["toxicity"] < first.count() and kept["near_duplicates"] < kept["toxicity"]


def test_rows_with_nulls_pass(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, "/root/testdata/sf0.001"), name)
    assert docs.count() > 0
