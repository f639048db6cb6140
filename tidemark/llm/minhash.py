"""MinHash near-duplicates by a signature-coordinate inverted join.

1. A text is the set of its distinct shingles of five words. Texts with equal sets are one class; all that follows is
   over classes, so copies cost nothing.
2. A class has COORDINATES minima. Each pair (coordinate, minimum) is a token, and the class is posted under it.
3. Two sets of the least similarity agree in at least `matches` coordinates, but for a chance of MISS. So they
   share one of the COORDINATES - matches + 1 tokens that come first in any order common to all classes: only
   that prefix is posted. The order is by frequency, rarest first: what many texts share (a passage, a licence) is
   out of nearly every prefix. Tokens that only one class has are not posted at all.
4. The classes of a posting list are merged by a walk that counts agreeing coordinates against classes not yet reached
   only, skipping all that is connected already. What leaves the list is a forest, not its pairs.
5. Connected candidates come together with their full sets, where exact counts confirm links; the walk skips here in
   the same way.
6. Long lists and large sets of candidates are first compared with a few of their own classes (representatives). What is tied to the one that most
   are tied to is one component already, so among these nothing is left to find. The rest is dealt in blocks, each with every
   block of the whole. A group of near copies, however large, costs what it has rows; only lists whose classes
   are not alike grow with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, attach, components, deal, map_batches, raw, runs, table

COORDINATES, MISS = 64, 1e-6
#: A posting list above CHUNK classes is long, a set of candidates above 2 * BLOCK is large.
CHUNK, BLOCK = 1024, 128
#: Representatives of a long list or a large set of candidates.
STAND = 4
#: Bits of the tables of token counts and of needed classes; they grow with the classes up to this size (2 MB each).
MOST_BITS = 20

_U = np.uint64
_RANDOM = np.random.default_rng(20_240_229)
_XOR, _MULTIPLY = _RANDOM.integers(0, 2**64, COORDINATES, np.uint64), _RANDOM.integers(0, 2**64, COORDINATES, np.uint64) | _U(1)


def matches_needed(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of agreeing coordinates that sets of this similarity fall short of with a chance of at most `miss`."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates and below + (chance := comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)) <= miss:
        below += chance
        t += 1
    return max(1, t)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are fewer than 200,000 (about 40 MB)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text with fewer words is one shingle, one without words none.

    bytes.lower and bytes.split know A-Z and the six white-space bytes only, which is the contract's word.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    w = min(width, n)
    out = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : n - w + 1 + k]
    return np.unique(mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    return np.array([((s ^ x) * m).min() for x, m in zip(_XOR, _MULTIPLY)], np.uint64) >> _U(32)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def classify(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(id, text_hash, class, n, signature, low) for each row; class is null for texts without words, low has a byte of each minimum."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            cls, n, sig = [], [], []
            for text in raw(batch.column(2)):
                s = shingles(text, width, hashes)
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                sig.append(signature(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array([s and s[::4] for s in sig], pa.binary())], ["id", "text_hash", "class", "n", "signature", "low"])

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("text_hash"), F.col(text_column).alias("text"))
    return map_batches(rows, run, f"id {kind}, text_hash long, class long, n long, signature binary, low binary")


def tokens(signatures: list[bytes]) -> np.ndarray:
    s = np.frombuffer(b"".join(signatures), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
    return mix(s | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << _U(32)))


def bits_for(rows: int, least: int = 10) -> int:
    return int(min(MOST_BITS, max(least, np.ceil(np.log2(max(rows, 1))))))


def token_counts(classes: DataFrame, bits: int) -> np.ndarray:
    """How often tokens occur, by the first bits of their hash: a bounded table whatever the input is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            counts += np.bincount((tokens(batch.column(0).to_pylist()) >> _U(64 - bits)).ravel().astype(np.int64), minlength=1 << bits)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(counts[full], pa.int64())], ["cell", "n"])

    found = map_batches(classes.select("signature"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def postings(classes: DataFrame, counts: np.ndarray, prefix: int) -> DataFrame:
    """(token, class): the prefix of each class, without tokens that are known to be no other class's."""
    bits = int(np.log2(len(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tokens(batch.column(1).to_pylist())
            often = counts[(t >> _U(64 - bits)).astype(np.int64)]
            first = np.lexsort((t, often), axis=1)[:, :prefix]
            t, often = np.take_along_axis(t, first, 1), np.take_along_axis(often, first, 1)
            row, column = np.nonzero(often > 1)
            yield pa.RecordBatch.from_arrays([pa.array(t[row, column].view(np.int64), pa.int64()), batch.column(0).take(pa.array(row))], ["token", "class"])

    return map_batches(classes.select("class", "signature"), run, "token long, class long")


def merge_list(n: np.ndarray, low: np.ndarray, side: np.ndarray, matches: int, percent: int) -> list[tuple[int, int]]:
    """What is connected by pairs with enough agreeing coordinates and sizes that allow the similarity: (first, member).

    side: of two chunks only pairs across count (0 with 1), in one chunk (all 2) every pair. A walk from each class
    sees only those that nothing has reached yet. Members are tied to the first of their walk, which lists of
    the same classes have in common.
    """
    if len(n) > 2:
        low = np.ascontiguousarray(low)
    left, out = np.arange(len(n)), []
    whole = bool(len(side)) and side[0] == 2
    while len(left):
        first, left = int(left[0]), left[1:]
        todo = [first]
        while todo and len(left):
            u = todo.pop()
            fit = ((low[left] == low[u]).sum(1) >= matches) & (100 * np.minimum(n[left], n[u]) >= percent * np.maximum(n[left], n[u]))
            if not whole:
                fit &= side[left] != side[u]
            reached = left[fit]
            if len(reached):
                out += [(first, int(v)) for v in reached]
                todo += reached.tolist()
                left = left[~fit]
    return out


def representatives(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, stand): for each key a list of a few of its classes, with some columns, the same in every run."""
    lot = F.xxhash64(F.lit("stand"), "class")
    few = rows.groupBy(key, F.pmod(lot, F.lit(STAND)).alias("__lot")).agg(F.min(F.struct(lot.alias("lot"), "class", *columns)).alias("one"))
    return few.groupBy(key).agg(F.sort_array(F.collect_list("one")).alias("stand"))


def tie_batch(batch: pa.RecordBatch, key: str, ties: list[list[int]]) -> pa.RecordBatch:
    """(key, class, to, a, b) for each tie of each row, or one with nulls: the edge (a, b) is that of the class to its first tie, for the others one between
    representatives, so that there are about as many edges as classes."""
    cls = batch.column(1).to_pylist()
    rows = [(k, to, own[0], cls[k] if j == 0 else to) for k, own in enumerate(ties) for j, to in enumerate(own)] + [(k, None, None, None) for k, own in enumerate(ties) if not own]
    at, to, a, b = zip(*rows) if rows else ((),) * 4
    place = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *(pa.array(x, pa.int64()) for x in (to, a, b))], [key, "class", "to", "a", "b"])


def tied_to_most(ties: DataFrame, key: str) -> DataFrame:
    """(key, class, tied): whether a class is tied to the representative of its key that has the most ties. ties: (key, class, to), to is null where there is none."""
    most = ties.filter("to is not null").groupBy(key, "to").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("n", "to"))["to"].alias("__most"))
    return ties.join(most, key, "left").groupBy(key, "class").agg(F.coalesce(F.max(F.col("to") == F.col("__most")), F.lit(False)).alias("tied"))


def star(edges: DataFrame) -> DataFrame:
    """The same connections with fewer edges, from (first, member) of many lists: each member with the least of its firsts, and that one with the others."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    spokes = least.select(F.col("least").alias("a"), "b").unionByName(edges.join(least, "b").select(F.col("least").alias("a"), F.col("a").alias("b")))
    return spokes.filter("a != b").distinct()


def candidate_forest(posted: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """(a, b): classes connected in some posting list. Signatures, a byte of each minimum, join lists of two classes or more only."""
    lengths = posted.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1")
    rows = posted.join(lengths, "token").join(classes.select("class", "n", "low"), "class")
    short = rows.filter(F.col("length") <= CHUNK).select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), "class", "n", "low", F.lit(2).alias("side"))
    long = table(rows.filter(F.col("length") > CHUNK).select("token", "class", "n", "low"), "long")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class with the representatives of its list that it agrees with; itself alone where there are none."""
        for batch in batches:
            cls, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(n), -1)
            agrees = lambda x, k: x["class"] == cls[k] or ((np.frombuffer(x["low"], np.uint8) == low[k]).sum() >= matches and 100 * min(x["n"], n[k]) >= percent * max(x["n"], n[k]))  # noqa: B023, E731
            yield tie_batch(batch, "token", [[x["class"] for x in stand if agrees(x, k)] for k, stand in enumerate(batch.column(4).to_pylist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for group in runs(batches, 3):
            if group.num_rows > 1:
                cls, n, side = (group.column(k).to_numpy() for k in (3, 4, 6))
                low = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint8).reshape(len(n), -1)
                for u, v in merge_list(n, low, side, matches, percent):
                    held[0].append(cls[u])
                    held[1].append(cls[v])
            if len(held[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64())], ["a", "b"])
                held = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64())], ["a", "b"])

    dealt, edges = short, None
    if long.limit(1).count():
        stand = representatives(long, "token", ["n", "low"])
        tied = table(map_batches(long.join(stand, "token").select("token", "class", "n", "low", "stand"), tie, "token long, class long, to long, a long, b long"), "tied")
        edges = tied.filter("a != b").select("a", "b")
        dealt = dealt.unionByName(deal(long.join(tied_to_most(tied, "token"), ["token", "class"]), "token", CHUNK, ["class", "n", "low"]))
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "class")
    found = map_batches(dealt, run, "a long, b long")
    if edges is not None:
        found = found.unionByName(edges)
    # written, since a star reads them twice
    return star(table(found.filter("a != b").distinct(), "found"))


def needed_filter(needed: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of (text_hash, class), built on the executors: 2^bits words of 64, bounded whatever the input is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << bits, np.uint64)
        for batch in batches:
            for at, mask in places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits):
                np.bitwise_or.at(words, at, mask)
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(words[full].view(np.int64), pa.int64())], ["cell", "mask"])

    found = map_batches(needed.select("text_hash", "class"), run, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << bits, np.uint64)
    out[found["cell"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def places(text_hash: np.ndarray, cls: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    h = mix(text_hash.astype(np.int64).view(np.uint64) ^ mix(cls.astype(np.int64).view(np.uint64)))
    for k in range(3):
        x = mix(h + _U(k))
        yield (x >> _U(64 - bits)).astype(np.int64), _U(1) << (x & _U(63))


def full_sets(docs: DataFrame, needed: DataFrame, text_column: str, width: int) -> DataFrame:
    """(text_hash, class, shingles) of the needed (text_hash, class): texts are read again, and what the filter lets by is computed again.

    Where more classes are needed than the filter has room for, texts are first joined with the needed hashes.
    """
    rows = needed.count()
    bits = bits_for(rows)
    texts = docs.select(F.xxhash64(F.col(text_column)).alias("text_hash"), F.col(text_column).alias("text"))
    if rows > 8 << bits:
        texts = texts.join(needed.select("text_hash").distinct(), "text_hash", "left_semi")
    words = needed_filter(needed, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            th, cls, sets = batch.column(0).to_pylist(), [], []
            keep = []
            for k, text in enumerate(raw(batch.column(1))):
                s = shingles(text, width, hashes)
                if not len(s):
                    continue
                c = class_of(s)
                if all((words[at[0]] & mask[0]) for at, mask in places(np.array([th[k]]), np.array([c]), bits)):
                    keep.append(k)
                    cls.append(c)
                    sets.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([th[k] for k in keep], pa.int64()), pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["text_hash", "class", "shingles"])

    return map_batches(texts, run, "text_hash long, class long, shingles binary")


def link_forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(first, member) of what the links of one task connect, by exact counts over an inverted index of its shingles."""
    n, forest = len(sets), Forest(len(sets))
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    # who has a shingle, as one array by shingle
    owner = np.repeat(np.arange(n), size)
    by_value = np.argsort(at, kind="stable")
    owners, starts = owner[by_value], np.searchsorted(at[by_value], np.arange(len(values) + 1))
    whole = side[0] == 2
    for u in order.tolist():
        mine = at[ends[u] - size[u] : ends[u]]
        lengths = starts[mine + 1] - starts[mine]
        if lengths.sum() == size[u]:
            continue
        reach = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owners[reach], minlength=n)
        fit = (100 * both >= percent * (size + size[u] - both)) & (both > 0)
        if not whole:
            fit &= side != side[u]
        fit[u] = False
        for v in np.flatnonzero(fit).tolist():
            forest.join(u, v)
    return [(r, k) for k in range(n) if (r := forest.find(k)) != k]


def confirm(sets: DataFrame, needed: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect what is linked, from sets and (label, class, text_hash): exact counts within each label.

    Labels above 2 * BLOCK classes are compared with representatives first, the rest is dealt in blocks.
    """
    rows = sets.join(needed.join(needed.groupBy("label").agg(F.count("*").alias("members")), "label"), ["text_hash", "class"])
    short = rows.filter(F.col("members") <= 2 * BLOCK).select("label", F.lit(0).alias("i"), F.lit(0).alias("j"), "class", F.lit(2).alias("side"), "shingles")
    large = needed.groupBy("label").agg(F.count("*").alias("members")).filter(F.col("members") > 2 * BLOCK)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, "<u8") for x in batch.column(2).to_pylist()]
            ties = []
            for k, stand in enumerate(batch.column(3).to_pylist()):
                ties.append([])
                for x in stand:
                    other = np.frombuffer(x["shingles"], "<u8")
                    both = len(np.intersect1d(own[k], other, assume_unique=True))
                    if 100 * both >= percent * (len(own[k]) + len(other) - both):
                        ties[-1].append(x["class"])
            yield tie_batch(batch, "label", ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            if group.num_rows > 1:
                cls, side = group.column(3).to_numpy(), group.column(4).to_numpy()
                links = link_forest([np.frombuffer(x, "<u8") for x in group.column(5).to_pylist()], side, percent)
                if links:
                    u, v = np.array(links).T
                    yield pa.RecordBatch.from_arrays([pa.array(cls[u], pa.int64()), pa.array(cls[v], pa.int64())], ["a", "b"])

    dealt, edges = short, None
    if large.limit(1).count():
        wide = table(rows.filter(F.col("members") > 2 * BLOCK).select("label", "class", "shingles"), "wide")
        # few sets of each large label meet all of it
        stand = representatives(wide, "label", ["shingles"])
        tied = table(map_batches(wide.join(stand, "label").select("label", "class", "shingles", "stand"), tie, "label long, class long, to long, a long, b long"), "tied")
        edges = tied.filter("a != b").select("a", "b")
        dealt = dealt.unionByName(deal(wide.join(tied_to_most(tied, "label"), ["label", "class"]), "label", 8 * BLOCK, ["class", "shingles"]).select("label", "i", "j", "class", "side", "shingles"))
    dealt = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "class")
    found = map_batches(dealt, run, "a long, b long")
    return (found if edges is None else found.unionByName(edges)).filter("a != b")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, n, group, first_id) for each row: rows of one group are connected by links.

    A link is 100 * intersection >= percent * union of distinct shingles of `width` words (fewer words: the whole
    sequence is one). Null and empty texts have no shingles, a null group and no link. group is the class that stands for
    the group; first_id the smallest id in it (null ids aside). Equal rows share their group. An empty table gives an
    empty table.
    """
    matches = matches_needed(percent)
    rows = table(classify(docs, id_column, text_column, width), "classes")
    found = rows.filter("class is not null").groupBy("class")
    classes = table(found.agg(F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("low").alias("low"), F.min("text_hash").alias("text_hash"), F.min("id").alias("own_id"), F.count("*").alias("copies")), "distinct")
    many = classes.count()
    counts = token_counts(classes, bits_for(many * 16))
    forest = candidate_forest(postings(classes, counts, COORDINATES - matches + 1), classes, matches, percent)
    labels = components(forest)
    needed = table(labels.join(classes.select("class", "text_hash"), F.col("node") == F.col("class")).select("label", "class", "text_hash"), "needed")
    sets = table(full_sets(docs, needed, text_column, width).dropDuplicates(["text_hash", "class"]), "sets")
    linked = components(confirm(sets, needed, percent))
    # groups of several classes; all others are a class alone
    several = classes.select("class", "own_id", "copies").join(linked, F.col("class") == F.col("node")).select("class", "label", "own_id", "copies")
    totals = several.groupBy("label").agg(F.min("own_id").alias("first_id"), F.sum("copies").alias("members"))
    several = several.join(totals, "label").select("class", F.col("label").alias("group"), "first_id", "members")
    known = classes.select("class", "own_id", "copies").join(several, "class", "left").select("class", "copies", F.coalesce("group", "class").alias("group"), F.coalesce("first_id", "own_id").alias("first_id"), F.coalesce("members", "copies").alias("members"))
    return attach(rows.select("id", "text_hash", "n", "class"), table(known, "groups"), "class", "copies").select("id", "text_hash", "n", "group", "first_id", "members")


def components_by_document(docs: DataFrame, percent: int = 85, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: id, n_shingles, component_id (the smallest id reachable, itself included) and kept (it is its own).

    A null id takes the smallest id of its group and isn't kept if there is one.
    """
    found = near_duplicates(docs, percent, width, id_column, text_column)
    to = F.coalesce("first_id", "id")
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), to.alias("component_id"), F.col("id").eqNullSafe(to).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each group, that with the smallest id (nulls last, then text hash); rows without words stay."""
    from pyspark.sql import Window

    found = table(near_duplicates(docs, percent, width, id_column, text_column), "groups")
    best = found.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("best"))
    stay = best.select(F.col("best.id").alias("__id"), F.col("best.text_hash").alias("__hash"), F.lit(True).alias("__one"))
    stay = stay.union(found.filter("group is null").select("id", "text_hash", F.lit(False)).distinct())
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.col(text_column)))
    joined = hashed.join(stay, hashed[id_column].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")))
    place = F.row_number().over(Window.partitionBy(id_column, "__text_hash").orderBy(F.lit(0)))
    return joined.withColumn("__place", place).filter("not __one or __place = 1").select(*docs.columns)
