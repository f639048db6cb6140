"""Language-model scores by subword lattices.

A text is a sequence of words and an end. A word is spelled by pieces of an existing vocabulary: one that starts a word, others
that go on, a stop. The lattice of a word has an arc for every piece that fits somewhere in it; its probability is the
sum over all ways through the lattice, by a forward recursion in log space. The text's is the product over its words and the end.

Words that begin alike share the lattice of their beginning: words are sorted, each beginning is a place of a trie and has its arcs
and its forward sum once. An expectation step goes back through the same trie, for each language over the words that it has.

The vocabulary isn't learned, its unigram scores are: they start from the vocabulary's own order and take expectation steps, each over all
words of the training texts. (None of the public vocabularies here has unigram scores:
the one with scores has ranks of merges.)

Texts of different languages spell words differently, so scores are kept for each language of the training texts. A text's
probability is the sum over languages of the language's share times the text's probability there. The language of a
text that is scored isn't looked at. Spellings of one language have no more than all probability together: some segmentations
are of strings that no word has.

Corpus counts are a table of words that grows with the corpus and stays on the executors. A bounded head of it (the most frequent
words) goes along with the scoring tasks; all other words of a text meet the table in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import map_batches, raw, remainder, table

#: Bytes of pieces that long words are tried for (those that hold a longer one are tried for all), words in the head (a bound; the others are joined), and the number of expectation steps.
LONGEST, HEAD, STEPS = 16, 1 << 18, 6
#: Languages whose spellings are learned apart (the most frequent ones); all others are one more.
LANGUAGES = 8
#: Words above this many bytes are spelled one by one, in this many places at a time; the others in tries of about so many bytes of words.
LONG, SIDE, TRIE = 200, 1024, 1 << 20
#: Added to every piece's expected count.
PRIOR = 0.05
_B, _U = np.uint64(0x100000001B3), np.uint64
_MIX = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


class Pieces:
    """Pieces that lower-cased text can have: all single bytes, and those that hold white space at the front only.

    They are found by a hash of their bytes, or byte by byte: `steps[state, byte]` is the next state or -1, `number[state]` the piece that
    ends there or -1, and states that go on come first, with the beginning as 0.
    """

    def __init__(self, vocabulary: str):
        spelled = sorted(encoder(vocabulary).ids.items(), key=lambda x: x[1])
        upper, space = set(range(65, 91)), {9, 10, 11, 12, 13, 32}
        self.pieces = [b for b, _ in spelled if len(b) == 1 or not upper & set(b) and not space & set(b[1:]) and b[0] not in space - {32}]
        self.starts = np.array([b[0] == 32 for b in self.pieces])
        self.lengths = sorted({len(b) for b in self.pieces})
        self.long = regex.compile(b"|".join(map(regex.escape, sorted((b for b in self.pieces if len(b) > LONGEST), key=len, reverse=True))))
        keys = np.array([self.hash(b) for b in self.pieces], np.uint64)
        self.tables = []
        left = np.arange(len(keys))
        for mix, bits in zip(_MIX * 4, [20, 16] + [14] * 14):
            if not len(left):
                break
            slot = (keys[left] * mix) >> _U(64 - bits)
            held, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            _, first = np.unique(slot, return_index=True)
            held[slot[first]], ids[slot[first]] = keys[left[first]], left[first]
            self.tables.append((mix, _U(64 - bits), held, ids))
            left = np.delete(left, first)
        states = {b"": 0}
        before, byte = [0], [0]
        for b in self.pieces:
            for k in range(1, len(b) + 1):
                if b[:k] not in states:
                    states[b[:k]] = len(states)
                    before.append(states[b[: k - 1]])
                    byte.append(b[k - 1])
        goes = np.zeros(len(states), bool)
        goes[before] = True
        place = np.empty(len(states), np.int64)
        place[np.argsort(~goes, kind="stable")] = np.arange(len(states))
        self.number = np.full(len(states), -1, np.int32)
        self.number[place[[states[b] for b in self.pieces]]] = np.arange(len(self.pieces))
        self.steps = np.full((int(goes.sum()), 256), -1, np.int32)
        self.steps[place[before[1:]], byte[1:]] = place[1:]

    @staticmethod
    def hash(b: bytes) -> int:
        h = 0
        for c in b:
            h = (h * int(_B) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with this hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        for mix, shift, held, ids in self.tables:
            slot = (h * mix) >> shift
            out = np.where((held[slot] == h) & (out < 0), ids[slot], out)
        return out

    def start(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores from the vocabulary's order, by Zipf's law: merges are listed by frequency."""
        return renew(self, np.repeat(1e6 / (np.arange(len(self.pieces)) + 50.0)[:, None], groups, 1), np.full(groups, 1e6))


def renew(pieces: Pieces, expected: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group (column), log probabilities of pieces among those that start words or among those that go on, with the stop, and that of the stop.

    The last row of the scores is that of no piece (-1).
    """
    e = expected + PRIOR
    starts = pieces.starts[:, None]
    going = np.where(starts, 0.0, e).sum(0) + words + PRIOR
    scores = np.log(np.where(starts, e / np.where(starts, e, 0.0).sum(0), e / going))
    return np.concatenate([scores, np.full((1, scores.shape[1]), -np.inf)]), np.log((words + PRIOR) / going)


_PIECES: dict[str, Pieces] = {}


def pieces_of(vocabulary: str) -> Pieces:
    if vocabulary not in _PIECES:
        _PIECES[vocabulary] = Pieces(vocabulary)
    return _PIECES[vocabulary]


class Trie:
    """The beginnings of sorted words, each once, and the pieces that may stand before its end.

    Place 0 is before a blank in front of all words, 1 behind it; places are numbered by length. `levels` has for each length the first
    place and, of the pieces that end there, the end (counted from the first place, ascending), the begin and the number; `at` is where a word ends.
    """

    def __init__(self, pieces: Pieces, words: list[bytes]):
        x = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.cumsum(sizes) - sizes
        first, self.at, left = 1, np.zeros(len(words), np.int64), np.arange(len(words))
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        # what may go on behind each place of the last length: begin and state, with cuts between places
        begin, state, cuts = np.zeros(1, np.int64), np.zeros(1, np.int32), np.array([0, 1])
        last = 0
        for size in range(1, int(sizes.max(initial=0)) + 2):
            left = left[sizes[left] >= size - 1]
            byte = x[offsets[left] + size - 2] if size > 1 else np.full(len(left), 32, np.uint8)
            before = self.at[left]
            new = np.ones(len(left), bool)
            new[1:] = (before[1:] != before[:-1]) | (byte[1:] != byte[:-1])
            self.at[left] = first - 1 + np.cumsum(new)
            before, byte = before[new] - last, byte[new]
            n = len(before)
            many = cuts[before + 1] - cuts[before]
            end = np.repeat(np.arange(n), many)
            which = np.arange(len(end)) + np.repeat(cuts[before] - (np.cumsum(many) - many), many)
            state = pieces.steps[state[which], byte[end]]
            some = np.flatnonzero(state >= 0)
            end, begin, state = end[some], begin[which[some]], state[some]
            number = pieces.number[state]
            some = np.flatnonzero(number >= 0)
            self.levels.append((first, end[some], begin[some], number[some]))
            # pieces that go on, and behind them those that begin here
            some = np.flatnonzero(state < len(pieces.steps))
            end = end[some]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=n) + 1)])
            old = begin[some], state[some]
            begin, state = np.empty(cuts[-1], np.int64), np.zeros(cuts[-1], np.int32)
            begin[np.arange(len(some)) + end], state[np.arange(len(some)) + end] = old
            begin[cuts[1:] - 1] = np.arange(first, first + n)
            last, first = first, first + n
        self.places = first

    def forward(self, scores: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Natural log of the sum over ways to each place, and how likely each piece is the last one there."""
        f, likely = np.zeros(self.places), []
        for first, end, begin, number in self.levels:
            cuts = np.flatnonzero(np.diff(end, prepend=-1))
            t = f[begin] + scores[number]
            top = np.maximum.reduceat(t, cuts)
            t = np.exp(t - top[end])
            total = np.add.reduceat(t, cuts)
            f[first : first + len(cuts)] = top + np.log(total)
            likely.append(t / total[end])
        return f, likely

    def expected(self, scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected: from the ends back, a place's weight goes to the pieces that may be last there."""
        held = np.bincount(self.at, weights, self.places)
        _, likely = self.forward(scores)
        for (first, end, begin, _), p in zip(reversed(self.levels), reversed(likely)):
            p *= held[first + end]
            np.add.at(held, begin, p)
        return np.bincount(np.concatenate([x[3] for x in self.levels]), np.concatenate(likely), len(scores) - 1)


def in_order(words: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Sorted places of words, and those of words that are spelled one by one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    return order[sizes[order] <= LONG], np.flatnonzero(sizes > LONG).tolist()


def tries(pieces: Pieces, words: list[bytes], order: np.ndarray) -> Iterator[tuple[np.ndarray, Trie]]:
    """Parts of sorted places of words, and their tries."""
    if len(order):
        own = [words[k] for k in order.tolist()]
        cuts = np.flatnonzero(np.diff(np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) // TRIE)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
            yield order[begin:end], Trie(pieces, own[begin:end])


def all_arcs(pieces: Pieces, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, number) of every piece that fits somewhere in a word with a blank in front."""
    x = np.frombuffer(b" " + word, np.uint8).astype(np.uint64) + _U(1)
    most = pieces.lengths[-1] if pieces.long.search(b" " + word) else LONGEST
    h, found = np.zeros(len(x) + 1, np.uint64), []
    for size in range(1, min(most, len(x)) + 1):
        h = h[: len(x) - size + 1] * _B + x[size - 1 :]
        if size in pieces.lengths:
            number = pieces.find(h)
            at = np.flatnonzero(number >= 0)
            found.append((at, np.full(len(at), size), number[at]))
    return tuple(np.concatenate(c) for c in zip(*found))


def sweep(n: int, end: np.ndarray, size: np.ndarray, number: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Forward log sums at the places 0 to n of one word, a column for each group.

    A place is a sum over the `d` places before it. A long word is cut into parts that are swept side by side: first from each of d unit
    vectors, which gives what a part does to any beginning, then, from the beginnings that follow, once more for the sums.
    """
    groups, d = scores.shape[1], int(size.max())
    nothing, same = len(scores) - 1, len(scores)
    odds = np.concatenate([np.exp(scores), np.ones((1, groups))])
    parts = max(1, min(SIDE, int(sqrt(n)))) if d <= LONGEST else 1
    width = ceil(n / parts)
    table_ = np.full((parts * width + 1, d), nothing, np.int32)
    table_[end, size - 1] = number
    table_[n + 1 :, 0] = same
    steps = table_[1:].reshape(parts, width, d)

    def go(held: np.ndarray, out: np.ndarray | None, scale: np.ndarray) -> np.ndarray:
        """held: part, place before (nearest first), ..., group."""
        for k in range(width):
            weight = odds[steps[:, k]]
            new = np.einsum("plg,plg->pg" if out is not None else "plg,plbg->pbg", weight, held)
            held = np.concatenate([new[:, None], held[:, :-1]], 1)
            if k % 8 == 7 or k == width - 1:
                top = held.max(tuple(range(1, held.ndim - 1)))
                held /= top.reshape(parts, *[1] * (held.ndim - 2), groups)
                if out is not None:
                    out[:, k] = np.log(new) + scale
                scale += np.log(top)
            elif out is not None:
                out[:, k] = np.log(new) + scale
        return held

    first, scales = np.zeros((parts, d, groups)), np.zeros((parts, groups))
    first[0, 0] = 1.0
    if parts > 1:
        unit, grown = np.zeros((parts, d, d, groups)), np.zeros((parts, groups))
        unit[:, np.arange(d), np.arange(d)] = 1.0
        done = go(unit, None, grown)
        for k in range(1, parts):
            v = np.einsum("lbg,bg->lg", done[k - 1], first[k - 1])
            top = v.max(0)
            first[k], scales[k] = v / top, scales[k - 1] + grown[k - 1] + np.log(top)
    out = np.empty((parts, width, groups))
    go(first, out, scales)
    return np.concatenate([np.zeros((1, groups)), out.reshape(-1, groups)[:n]])


def word_scores(pieces: Pieces, scores: np.ndarray, stop: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of the probability that a word is spelled so, over all segmentations; a column for each group."""
    groups = scores.shape[1]
    out = np.zeros((len(words), groups))
    order, single = in_order(words)
    for part, trie in tries(pieces, words, order):
        for g in range(groups):
            out[part, g] = trie.forward(np.ascontiguousarray(scores[:, g]))[0][trie.at]
    for k in single:
        begin, size, number = all_arcs(pieces, words[k])
        out[k] = sweep(len(words[k]) + 1, begin + size, size, number, scores)[-1]
    return out + stop


def expected_counts(pieces: Pieces, scores: np.ndarray, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """How often each piece is expected in these words, over all segmentations by their likelihood; weights say how often a group (column) has a word."""
    groups = scores.shape[1]
    out = np.zeros((len(pieces.pieces), groups))
    order, single = in_order(words)
    for g in range(groups):
        # a group's words alone: most words are of one language
        for part, trie in tries(pieces, words, order[weights[order, g] != 0]):
            out[:, g] += trie.expected(np.ascontiguousarray(scores[:, g]), weights[part, g])
    for k in single:
        n = len(words[k]) + 1
        begin, size, number = all_arcs(pieces, words[k])
        forward = sweep(n, begin + size, size, number, scores)
        backward = sweep(n, n - begin, size, number, scores)[::-1]
        for some in np.array_split(np.arange(len(begin)), ceil(len(begin) / 100_000)):
            likely = np.exp(forward[begin[some]] + scores[number[some]] + backward[begin[some] + size[some]] - forward[-1]) * weights[k]
            np.add.at(out, number[some], likely)
    return out


def tokens(text: bytes) -> list[bytes]:
    """bytes.lower and bytes.split know A-Z and the six white-space bytes only."""
    return text.lower().split()


def count_words(docs: DataFrame, groups: int) -> DataFrame:
    """(word, c, c0, c1, ...) over (text, train, group): counts in training texts, all and of each group; the empty word is the end, once for each text."""

    def emit(found: list[Counter]) -> Iterator[pa.RecordBatch]:
        for group, own in enumerate(found):
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(list(own.keys()), pa.binary()), pa.array([group] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["word", "group", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one more for words of texts that aren't learned from
        found = [Counter() for _ in range(groups + 1)]
        for batch in batches:
            for text, train, group in zip(raw(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = tokens(text)
                if train:
                    found[group].update(words)
                    found[group][b""] += 1
                else:
                    own = found[groups]
                    for w in words:
                        if w not in own:
                            own[w] = 0
            if sum(map(len, found)) > 500_000:
                yield from emit(found)
                found = [Counter() for _ in range(groups + 1)]
        yield from emit(found)

    rows = map_batches(docs, run, "word binary, group int, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("group") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(groups)])


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


@dataclass
class Model:
    """What scoring tasks get: pieces' scores, totals, and the head of the word table. `words` stays on the executors.

    Groups are the columns of scores, counts and spellings; without languages there is one, of everything.
    """

    vocabulary: str
    scores: np.ndarray
    stop: np.ndarray
    total: int
    distinct: int
    ends: int
    group_total: np.ndarray
    group_ends: np.ndarray
    head: dict[bytes, int]
    head_count: np.ndarray
    head_spell: np.ndarray
    words: DataFrame | None = None

    @property
    def groups(self) -> int:
        return len(self.group_total)

    @property
    def shares(self) -> np.ndarray:
        """Log of each group's share of texts."""
        return np.log(np.maximum(self.group_ends, 1) / np.maximum(self.group_ends, 1).sum())

    def end(self) -> np.ndarray:
        """Log probability that a token is the end; a word is one that isn't."""
        return np.log(self._ends())

    def going_on(self) -> np.ndarray:
        return np.log1p(-self._ends())

    def _ends(self) -> np.ndarray:
        return np.minimum(np.maximum(self.group_ends, 0.5) / np.maximum(self.group_total, 1), 1 - 1e-9)


def head_of(counts: DataFrame, most: int) -> pa.Table:
    """The most frequent words: all with a count above the least one that leaves at most `most` of them."""
    eighth = F.floor(F.log2("c") * 8).cast("int")
    levels = {r["level"]: r["n"] for r in counts.filter("c > 0 and word != X''").groupBy(eighth.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, n = None, 0
    for level in sorted(levels, reverse=True):
        if n + levels[level] > most:
            break
        least, n = level, n + levels[level]
    if least is None:
        return counts.limit(0).toArrow()
    return counts.filter("c > 0 and word != X''").filter(eighth >= least).toArrow()


def learn(docs: DataFrame, train: Column, vocabulary: str, text_column: str = "text", language_column: str | None = "lang") -> Model:
    """docs: all texts; train: a condition for those to learn from. Words of the others are in the table with a count of 0."""
    train = F.coalesce(train, F.lit(False))
    names = []
    if language_column in docs.columns:
        names = [r["g"] for r in docs.filter(train & F.col(language_column).isNotNull()).groupBy(F.col(language_column).cast("string").alias("g")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(LANGUAGES).collect()]
    # texts of other languages, or of none, are a group of their own
    rest = docs.filter(train & (F.lit(True) if not names else ~F.coalesce(F.col(language_column).cast("string").isin(names), F.lit(False)))).limit(1).count() > 0 or not names
    groups = len(names) + int(rest)
    group = F.lit(groups - 1)
    for k, name in enumerate(names):
        group = F.when(F.col(language_column).cast("string") == name, F.lit(k)).otherwise(group)
    # sorted, so that the words of a batch begin alike
    counts = table(count_words(docs.select(F.col(text_column).alias("text"), train.alias("train"), group.alias("group")), groups).sortWithinPartitions("word"), "counts")
    word = F.expr("word != X''")
    own = [f"c{k}" for k in range(groups)]
    t = counts.agg(
        F.sum("c").alias("total"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct"), F.max(F.when(~word, F.col("c"))).alias("ends"), 
        *[F.sum(c).alias(f"total_{c}") for c in own], *[F.count(F.when((F.col(c) > 0) & word, 1)).alias(f"types_{c}") for c in own], *[F.max(F.when(~word, F.col(c))).alias(f"ends_{c}") for c in own],
    ).first()
    total, distinct, ends = t["total"] or 0, t["distinct"], t["ends"] or 0
    group_total, group_types, group_ends = (np.array([t[f"{x}_{c}"] or 0 for c in own], float) for x in ("total", "types", "ends"))
    head = head_of(counts, HEAD)
    matrix = lambda part: np.stack([part[c].to_numpy() for c in ("c", *own)], 1).astype(np.int64)
    words, c = head["word"].to_pylist(), head["c"].to_numpy()
    pieces = pieces_of(vocabulary)
    scores, stop = pieces.start(groups)
    seen = counts.filter((F.col("c") > 0) & word)
    for _ in range(STEPS):

        def expect(batches: Iterator[pa.RecordBatch], scores=scores, stop=stop) -> Iterator[pa.RecordBatch]:
            mine = pieces_of(vocabulary)
            out = np.zeros((len(mine.pieces), groups))
            for part in gathered(batches):
                out += expected_counts(mine, scores, part["word"].to_pylist(), (matrix(part)[:, 1:] > 0).astype(float))
            some, column = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(column, pa.int64()), pa.array(out[some, column], pa.float64())], ["piece", "group", "n"])

        found = map_batches(seen, expect, "piece long, group long, n double").groupBy("piece", "group").agg(F.sum("n").alias("n")).toArrow()
        if not found.num_rows:
            break
        expected = np.zeros((len(pieces.pieces), groups))
        expected[found["piece"].to_numpy(), found["group"].to_numpy()] = found["n"].to_numpy()
        scores, stop = renew(pieces, expected, group_types)
    bare = Model(vocabulary, scores, stop, total, distinct, ends, group_total, group_ends, {}, c[:0], np.zeros((0, groups)))
    model = replace(bare, head={w: k for k, w in enumerate(words)}, head_count=c, head_spell=word_scores(pieces, scores, stop, words))
    columns = [f"p{k}" for k in range(groups)]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pieces_of(vocabulary)
        for part in gathered(batches):
            spelled = word_scores(mine, scores, stop, part["word"].to_pylist())
            p = spelled + bare.going_on()
            yield from pa.table([part["word"], part["c"], *(pa.array(p[:, k], pa.float64()) for k in range(groups))], names=["word", "c", *columns]).to_batches()

    # words of the head are looked up, not joined
    least = int(c.min()) if len(c) else None
    model.words = table(map_batches(counts.filter(word if least is None else word & (F.col("c") < least)), give, "word binary, c long, " + ", ".join(f"{x} double" for x in columns)), "words")
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", held_out_divisor: int = 7, held_out_remainder: int = 2) -> DataFrame:
    """log10 probabilities of every whole text. Returns id, held_out, n_tokens, n_known, train_tokens, base_score
    and score (by the lattice of pieces, summed over languages).

    Null and empty texts are an end alone. Null and repeated ids are kept. Words that training doesn't have get their lattice
    probability as all others. An empty table gives an empty table.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    log10 = float(np.log(10.0))
    bottom = float(np.log10(model.total + model.distinct + 1))
    groups = model.groups
    columns = [f"p{k}" for k in range(groups)]
    head, head_score = model.head, model.head_spell + model.going_on()
    head_base = np.log10(model.head_count + 1.0) - bottom
    end_base, end_score, end_known = float(np.log10(model.ends + 1) - bottom), model.end() + model.shares, int(model.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            sums = np.zeros((batch.num_rows, groups))
            for row, text in enumerate(raw(batch.column(2))):
                words = tokens(text)
                at = np.fromiter((head.get(w, -1) for w in words), np.int64, len(words))
                inside = at[at >= 0]
                tail = Counter([words[k] for k in np.flatnonzero(at < 0).tolist()])
                sums[row] = head_score[inside].sum(0) + end_score
                for column, value in zip(out, (len(words) + 1, len(inside) + end_known, head_base[inside].sum() + end_base, list(tail.keys()), list(tail.values()))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds), *(pa.array(sums[:, k], pa.float64()) for k in range(groups))], ["id", "held_out", "n_tokens", "n_known", "base_score", "words", "times", *columns])

    rows = docs.select(F.col(id_column).alias("id"), (remainder(id_column, held_out_divisor) == held_out_remainder).alias("held_out"), F.col(text_column).alias("text"))
    part = map_batches(rows, run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, words array<binary>, times array<int>, " + ", ".join(f"{x} double" for x in columns))
    # the number of a row is written with it, so that it is the same in both branches
    part = table(part.withColumn("row", F.monotonically_increasing_id()), "parts")
    tail = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("n"))
    n = F.col("n")
    more = tail.join(model.words, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("more_known"), F.sum(n * (F.log10(F.col("c") + 1) - F.lit(bottom))).alias("more_base"), *[F.sum(n * F.col(x)).alias(f"more_{x}") for x in columns]
    )
    plus = lambda c, m: F.col(c) + F.coalesce(F.col(m), F.lit(0))
    joined = part.drop("words", "times").join(more, "row", "left").withColumns({x: plus(x, f"more_{x}") for x in columns})

    top = F.greatest(*columns) if groups > 1 else F.col(columns[0])
    marginal = top + F.log(reduce(lambda a, b: a + b, [F.exp(F.col(x) - top) for x in columns]))
    return joined.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), plus("base_score", "more_base").alias("base_score"), (marginal / F.lit(log10)).alias("score")
    )


def score_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", held_out_divisor: int = 7, held_out_remainder: int = 2) -> DataFrame:
    """Learns from the rows whose crc32(id) mod held_out_divisor isn't held_out_remainder, and scores all."""
    model = learn(docs, remainder(id_column, held_out_divisor) != held_out_remainder, vocabulary, text_column)
    return score(docs, model, id_column, text_column, held_out_divisor, held_out_remainder)
