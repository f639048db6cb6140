"""The thin queries opN_<name>: each applies its operator to its whole table and shapes the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, lattice, minhash, mixing, oracles, secrets, shards, sketch, surrogates, toxicity, vectors
from .common import read

#: Where the public vocabulary is, here and on the executors; a parameter of the operators.
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(read(spark, sf_dir, "documents"), VOCABULARY)


def op2_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op3_block_max_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


#: In production the key is a secret; these tables are synthetic.
KEY = "fixture-key"


def op4_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(read(spark, sf_dir, "documents"), KEY)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("repeats", "part", "text_hash")


def op6_bpe_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), VOCABULARY)


def op7_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(read(spark, sf_dir, "documents"))


def op8_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balance(read(spark, sf_dir, "documents"), shards=16)


def op9_minhash_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_by_document(read(spark, sf_dir, "documents"), percent=85)


def op10_sorted_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), least_cosine=0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_subword_lattice, op2_grammar_secrets, op3_block_max_neighbours, op4_keyed_surrogates, op5_mix_sources, op6_bpe_prefix_trie, op7_bottom_k_sketch, op8_karmarkar_karp_shards, op9_minhash_coordinate_join, op10_sorted_projection_passes)}

#: Twins in SQL; the other queries' results aren't SQL, tests hold them against brute force.
ORACLES: dict[str, str] = {"op5_mix_sources": oracles.MIX, "op9_minhash_coordinate_join": oracles.NEAR, "op10_sorted_projection_passes": oracles.VECTORS}
