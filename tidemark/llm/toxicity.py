"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all words that the examples have. A word's weight is its inverse document frequency in the whole corpus times
how far the labelled classes differ in it; that factor is LEAST_FACTOR for words that don't tell them apart, so every word counts
and every text that shares a word with an example has neighbours. The nearest examples by exact cosine come from an inverted index
in blocks of examples: a posting list is a slice for each block, each block has the largest weight of each term, and
slices of blocks whose bound is below the k-th best so far are never read. Votes weighted by similarity are calibrated
on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, remainder, texts

#: Bounds of the sample of labelled rows: examples of each class, the first by hash of their id, among those of at most so many bytes of text.
TOXIC_EXAMPLES, CLEAN_EXAMPLES, LONGEST_EXAMPLE = 800, 1200, 1 << 17
#: A word's factor grows from the least to 1 more where the classes' document frequencies differ by 4 to 8 standard errors, in either direction.
LEAST_FACTOR, FROM_Z, TO_Z = 0.2, 4.0, 8.0
NEIGHBOURS, BLOCK = 15, 64


def inner(word: str) -> str:
    """From the first letter or digit to the last; empty if there is none."""
    word = word.strip(string.punctuation)  # which is quick, and often all
    if word.isalnum():
        return word
    first = next((k for k, c in enumerate(word) if c.isalnum()), len(word))
    last = next((k for k in range(len(word), first, -1) if word[k - 1].isalnum()), first)
    return word[first:last]


def split(text: str) -> list[str]:
    """Words in lower case, as they stand."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()


def count(text: str, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """A text's terms and how often it has each. A word that isn't known as it stands may be without the signs around it."""
    words = split(text)
    found = list(map(number.get, words))
    for k, x in enumerate(found):
        if x is None:
            found[k] = -1 if words[k].isalnum() else number.get(inner(words[k]), -1)
    terms, counts = np.unique(np.fromiter(found, np.int64, len(found)), return_counts=True)
    first = int(len(terms) > 0 and terms[0] < 0)
    return terms[first:], counts[first:]


@dataclass
class Index:
    """Labelled examples as posting lists in slices by block, with block maxima."""

    vocabulary: list[str]
    weight: np.ndarray  # of terms
    labels: np.ndarray  # of examples
    stand_for: np.ndarray  # of examples: how many labelled rows each stands for
    ids: list
    terms: np.ndarray  # of postings, by term and example
    docs: np.ndarray
    values: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)  # calibration: logit of the score = first * vote + second
    share: float = 0.0  # of toxic rows among the labelled ones: the vote of a text without neighbours
    offsets: np.ndarray = field(default=None)
    block_max: np.ndarray = field(default=None)
    number: dict[str, int] = field(default=None)

    @classmethod
    def of(cls, vocabulary: list[str], weight: np.ndarray, labels: np.ndarray, stand_for: np.ndarray, ids: list, found: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        vectors = [vector(weight, *f) for f in found]
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        values = np.concatenate([v for _, v in vectors]) if vectors else np.empty(0)
        docs = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        order = np.lexsort((docs, terms))
        total = float(stand_for.sum())
        return cls(vocabulary, weight, labels, stand_for, ids, terms[order].astype(np.int32), docs[order].astype(np.int32), values[order], share=float(stand_for[labels == 1].sum()) / total if total else 0.0).laid_out()

    def __getstate__(self) -> dict:
        """What follows from the postings isn't sent to the tasks."""
        return self.__dict__ | {"offsets": None, "block_max": None, "number": None}

    def laid_out(self) -> Index:
        if self.offsets is None:
            blocks = self.blocks
            cell = self.terms.astype(np.int64) * blocks + self.docs // BLOCK
            counts = np.bincount(cell, minlength=len(self.weight) * blocks)
            self.offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            self.block_max = np.zeros(len(self.weight) * blocks, np.float32)
            full = np.flatnonzero(counts)
            if len(full):
                self.block_max[full] = np.nextafter(np.maximum.reduceat(self.values, self.offsets[full]).astype(np.float32), np.float32(2))
            self.block_max = self.block_max.reshape(-1, blocks)
            self.number = {t: k for k, t in enumerate(self.vocabulary)}
        return self

    @property
    def blocks(self) -> int:
        return max(1, -(-len(self.labels) // BLOCK))

    def read(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
        """Exact cosines with the examples of some blocks, from these blocks' slices of the posting lists (None: whole lists); 0 elsewhere."""
        if blocks is None:
            begin, size, weight = self.offsets[terms * self.blocks], self.offsets[(terms + 1) * self.blocks], q
        else:
            cells = (terms[:, None] * self.blocks + blocks).ravel()
            begin, size, weight = self.offsets[cells], self.offsets[cells + 1], np.repeat(q, len(blocks))
        size = size - begin
        some = np.flatnonzero(size)
        if not len(some):
            return np.zeros(len(self.labels))
        begin, size = begin[some], size[some]
        ends = np.cumsum(size)
        at = np.repeat(begin - ends + size, size) + np.arange(ends[-1])
        return np.bincount(self.docs[at], self.values[at] * np.repeat(weight[some], size), len(self.labels))

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples that share a word, by descending exact cosine and then place; skip is left out.

        The blocks with the highest bounds give a k-th best; of the others those that can reach it are read.
        """
        if not len(terms) or not len(self.labels):
            return np.empty(0, np.int64), np.empty(0)
        n = len(self.labels)
        bound = (q.astype(np.float32) @ self.block_max[terms]) * np.float32(1 + 1e-5) + np.float32(1e-9)
        order = np.argsort(-bound, kind="stable")
        first = order[: 2 + k // BLOCK]
        scores = self.read(terms, q, first)
        if skip >= 0:
            scores[skip] = 0.0
        kth = np.partition(scores, -k)[-k] if n > k else 0.0
        more = order[len(first) :]
        more = more[bound[more] >= max(kth, 2e-9)]
        if 3 * len(more) > self.blocks:
            scores = self.read(terms, q, None)
        elif len(more):
            scores += self.read(terms, q, more)
        if skip >= 0:
            scores[skip] = 0.0
        if len(more) and n > k:
            kth = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= max(kth, 1e-300))
        best = some[np.lexsort((some, -scores[some]))][:k]
        return best, scores[best]

    def vote(self, found: tuple[np.ndarray, np.ndarray], skip: int = -1) -> tuple[float, str]:
        """Share of toxic weight among the nearest, each by its squared similarity, and the evidence."""
        best, near = self.nearest(*vector(self.weight, *found), skip=skip)
        strength = self.stand_for[best] * near**2
        total = float(strength.sum())
        vote = float(strength[self.labels[best] == 1].sum()) / total if total else self.share
        return vote, ",".join(f"{self.ids[i]}:{int(self.labels[i])}:{s:.3f}" for i, s in zip(best[:3].tolist(), near[:3].tolist()))

    def score(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[float, str]:
        if not len(self.labels):
            return 0.0, ""
        vote, evidence = self.vote(found)
        return (float(1 / (1 + np.exp(-(self.line[0] * vote + self.line[1])))), evidence) if evidence else (self.share, "")


def vector(weight: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their shares of a unit vector: (1 + log of the count) times the term's weight."""
    w = (1 + np.log(counts)) * weight[terms]
    norm = np.sqrt(w @ w)
    return terms, w / norm if norm else w


def calibrate(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """A logistic line through the votes, by weighted Newton steps with a small pull to 0."""
    x, beta = np.stack([votes, np.ones(len(votes))], 1), np.zeros(2)
    weights = weights / weights.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (weights * (labels - p)) - 1e-2 * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def factors(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int) -> np.ndarray:
    """How much the classes' shares of examples with a term differ, in standard errors, as a factor."""
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    counts = np.zeros((2, terms))
    for (has, _), label in zip(found, labels.tolist()):
        counts[label, has] += 1
    both = counts.sum(0) / (n1 + n0)
    z = np.abs(counts[1] / n1 - counts[0] / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-6) * (1 / n1 + 1 / n0))
    return LEAST_FACTOR + np.clip((z - FROM_Z) / (TO_Z - FROM_Z), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", held_out_divisor: int = 5) -> Index:
    """An index of a bounded sample of labelled rows whose crc32(id) mod held_out_divisor isn't 0. Document frequencies are of all docs.

    Of an id that occurs more than once the smallest text is the example; a row that is labelled both ways is toxic.
    """
    marked = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & (remainder(id_column, held_out_divisor) != 0)).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    every = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample: dict = {}
    for label, most in ((1, TOXIC_EXAMPLES), (0, CLEAN_EXAMPLES)):
        sample |= {r["id"]: label for r in marked.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most).collect()}
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(sample.items()), f"id {docs.schema[id_column].dataType.simpleString()}, label int")
    light = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # at most TOXIC_EXAMPLES + CLEAN_EXAMPLES ids, of at most LONGEST_EXAMPLE bytes each
    examples = light.filter(F.octet_length("text") <= LONGEST_EXAMPLE).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts(batch.column(2)):
                own = Counter(w if w.isalnum() else inner(w) for w in split(text))
                own.pop("", None)
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(f.keys()) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["id", "label", "terms", "counts"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = map_batches(examples.select("id", "label", "text"), counted, f"id {kind}, label int, terms array<string>, counts array<long>").collect()
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    number = {t: k for k, t in enumerate(vocabulary)}
    known = spark.sparkContext.broadcast(number)  # words of at most so many examples of bounded length

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(len(known.value), np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                n += 1
                found[count(text, known.value)[0]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(found[some], n), pa.int64())], ["term", "n"])

    df = map_batches(light.select("text"), document_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    known.unpersist()
    seen = dict(zip(df["term"].to_pylist(), df["n"].to_pylist()))
    total = seen.get(-1, 0)
    idf = np.array([np.log((2 + total) / (1 + seen.get(k, 0))) for k in range(len(vocabulary))])
    found = [(np.array([number[t] for t in r["terms"]], np.int64), np.array(r["counts"], np.int64)) for r in rows]
    weight = idf * factors(found, np.array([r["label"] for r in rows], np.int64), len(vocabulary))

    def place(k: int) -> tuple:
        """Examples with the same leading words stand together, which makes block bounds tight."""
        terms, counts = found[k]
        if not len(terms):
            return -1, -1, rows[k]["id"]
        heavy = int(terms[np.argmax(vector(weight, terms, counts)[1])])
        return heavy if weight[heavy] > 2 * LEAST_FACTOR * idf[heavy] else -1, int(terms[np.argmax(counts)]), rows[k]["id"]

    order = sorted(range(len(rows)), key=place)
    weigh = {label: every.get(label, 0) / max(1, sum(r["label"] == label for r in rows)) for label in (0, 1)}
    in_order = [rows[k] for k in order]
    index = Index.of(vocabulary, weight, np.array([r["label"] for r in in_order], np.int64), np.array([weigh[r["label"]] for r in in_order], float), [r["id"] for r in in_order], [found[k] for k in order])
    if len(rows) > 1:
        votes = np.array([index.vote(found[k], skip=at)[0] for at, k in enumerate(order)])
        index.line = calibrate(votes, index.labels.astype(float), index.stand_for)
    return index


def score(docs: DataFrame, index: Index, id_column: str = "doc_id", text_column: str = "text", held_out_divisor: int = 5) -> DataFrame:
    """id, held_out, score, predicted and evidence (the three nearest examples as id:label:cosine) of every whole text.

    Null and empty texts, and texts without a word that an example has, get the share of toxic rows among the labelled ones; without any
    labelled row every score is 0. Ties in similarity go to the earlier example. Null and repeated ids are kept. An empty table gives an empty table.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), (remainder(id_column, held_out_divisor) == 0).alias("held_out"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.laid_out().number
        for batch in batches:
            found = [index.score(count(t, number)) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.string())], [id_column, "held_out", "score", "predicted", "evidence"])

    return map_batches(rows, run, f"{id_column} {kind}, held_out boolean, score double, predicted int, evidence string")


def drop_toxic(docs: DataFrame, index: Index, text_column: str = "text") -> DataFrame:
    """docs without those predicted toxic. All columns go along, so nothing is joined."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.laid_out().number
        for batch in batches:
            yield batch.filter(pa.array([index.score(count(t, number))[0] < 0.5 for t in texts(batch.column(at))], pa.bool_()))

    return map_batches(docs, run, docs.schema)
