"""Near-duplicate vectors by sorted passes over random projections.

Every pass orders the vectors by 64 concatenated one-bit hashes (signs of random projections of what differs from the mean vector), cuts the order into blocks,
and compares each vector with those of its own block and the two beside it. Pairs are verified by exact cosines in double precision; what
the passes verify is united. Equal vectors are one class first, so copies cost nothing and all of them are linked.

The passes only tell what is connected: a task emits one edge for each connected vector, not its pairs. Links are then counted
within each component, all its members with all others, in pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, attach, components, deal, map_batches, runs, table

BITS, BLOCK, BLOCKS_A_TASK = 64, 256, 2
#: Members of a component that are compared at once; larger components are dealt in pairs of chunks of about this size.
CHUNK = 1024
#: A pair at the threshold is to be found with this chance. The number of passes for it is measured, at every size of the input. Vectors for which
#: the most wouldn't do have all their pairs compared besides.
CHANCE, LEAST_PASSES, MOST_PASSES = 0.97, 8, 512
#: Vectors and bytes of the sample that passes are tried on, and partners planted in it.
SAMPLE, SAMPLE_BYTES, PLANTED = 8192, 32 << 20, 512


def passes_for(vectors: int, least_cosine: float) -> int:
    """A pair stays together in a pass if it agrees in the leading bits that tell blocks apart; how likely that is in evenly spread vectors gives the least number of passes."""
    bits = max(0.0, log2(max(1, vectors) / (1.5 * BLOCK)))
    together = (1 - acos(least_cosine) / pi) ** bits
    needed = 1 if together >= CHANCE else ceil(log(1 - CHANCE) / log(1 - together))
    return min(MOST_PASSES, max(LEAST_PASSES, needed))


def passes_by_trial(x: np.ndarray, centre: np.ndarray, vectors: int, least_cosine: float, seed: int) -> int | None:
    """The passes after which partners at the threshold are found in a sample x of so many vectors; None if MOST_PASSES don't do.

    Half of the partners lie in the direction of another vector and half in a random one; both halves have to be found.
    """
    n, rng = len(x), np.random.default_rng([seed, x.shape[1]])
    own = x[:PLANTED]
    toward = rng.standard_normal(own.shape)
    toward[::2] = (x[rng.permutation(n)[: len(own)]] - own)[::2]
    toward -= (toward * own).sum(1, keepdims=True) * own
    toward /= np.maximum(np.sqrt((toward * toward).sum(1, keepdims=True)), 1e-12)
    a, b = own - centre, least_cosine * own + np.sqrt(1 - least_cosine**2) * toward - centre
    cosine = (a * b).sum(1) / np.maximum(np.sqrt((a * a).sum(1) * (b * b).sum(1)), 1e-12)
    # between two vectors of the sample the order goes on by further bits
    agree = (1 - np.arccos(np.clip(cosine, -1, 1)) / pi) ** max(0.0, log2(vectors / n / (1.5 * BLOCK)))
    missed = np.ones(len(own))
    for number in range(MOST_PASSES):
        keys = np.sort(sort_keys(x - centre, number, seed))
        apart = np.abs(np.searchsorted(keys, sort_keys(a, number, seed)) - np.searchsorted(keys, sort_keys(b, number, seed)))
        missed *= 1 - np.where(apart == 0, agree, np.clip(2 - apart * (vectors / n / BLOCK), 0, 1))
        if all(half.mean() <= 1 - CHANCE for half in (missed[::2], missed[1::2]) if len(half)):
            return number + 1
    return None


def projections(dimensions: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dimensions]).standard_normal((dimensions, BITS))


def sort_keys(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """64 signs as one signed number whose order is the lexicographic order of the bits."""
    bits = np.packbits(x @ projections(x.shape[1], number, seed) >= 0, axis=1)
    return (np.frombuffer(bits.tobytes(), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def unit(rows: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # very large or small components don't overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classify(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, str]:
    """(id, class, dimensions, vector as bytes); class is null for vectors that are null, zero or hold null or non-finite components."""
    element = vectors.schema[vector_column].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    id_kind = vectors.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            cls: list = []
            size: list = []
            data: list = []
            for v in column:
                own = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(x).all() and x.any():
                        own = (x + 0).tobytes()  # -0.0 is 0.0
                data.append(own)
                size.append(len(v.values) if own else None)
                cls.append(xxhash.xxh3_64_intdigest(own) - 2**63 if own else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], ["id", "class", "dimensions", "vector"])

    return map_batches(vectors.select(F.col(id_column).alias("id"), F.col(vector_column)), run, f"id {id_kind}, class long, dimensions long, vector binary"), kind


def centres(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """The mean unit vector of each length, from sums of whole numbers, which don't depend on an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for d in np.unique(sizes).tolist():
                x = unit(batch.filter(pa.array(sizes == d)).column(1).to_pylist(), kind)
                sums[d] = sums.get(d, 0) + np.rint(x * 2**28).astype(np.int64).sum(0)
        for d, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int64()), pa.array(np.arange(d), pa.int64()), pa.array(x, pa.int64())], ["dimensions", "at", "x"])

    count = {r["dimensions"]: r["n"] for r in classes.groupBy("dimensions").agg(F.count("*").alias("n")).collect()}
    out = {d: np.zeros(d) for d in count}
    for r in map_batches(classes.select("dimensions", "vector"), run, "dimensions long, at long, x long").groupBy("dimensions", "at").agg(F.sum("x").alias("x")).collect():
        out[r["dimensions"]][r["at"]] = r["x"] / 2**28 / count[r["dimensions"]]
    return out


def plan(classes: DataFrame, kind: str, centre: dict[int, np.ndarray], least_cosine: float, seed: int) -> tuple[int, list[int]]:
    """The number of passes, and the lengths of which all pairs are compared besides, because passes don't do there."""
    passes, whole = LEAST_PASSES, []
    for r in classes.groupBy("dimensions").agg(F.count("*").alias("n")).collect():
        d, n = r["dimensions"], r["n"]
        # classes are hashes, so the least are a sample
        least = classes.filter(F.col("dimensions") == d).orderBy("class").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))).select("vector").collect()
        tried = passes_by_trial(unit([bytes(x["vector"]) for x in least], kind), centre[d], n, least_cosine, seed)
        passes = max(passes, passes_for(n, least_cosine), tried or 0)
        if tried is None:
            whole.append(d)
    return passes, whole


def places(classes: DataFrame, kind: str, passes: int, seed: int, centre: dict[int, np.ndarray]) -> DataFrame:
    """(class, blocks): the block of each pass that a vector is in. All passes are sorted at once, by ranges; ranks are places in a range plus the rows of the ranges before."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                x, cls = unit(part.column(2).to_pylist(), kind) - centre[d], part.column(0)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p), pa.int32()), part.column(1), pa.array(sort_keys(x, p, seed), pa.int64()), cls], ["pass", "dimensions", "key", "class"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), pa.array(np.full(n, own), pa.int32()), pa.array(np.arange(at, at + n), pa.int64())], ["class", "pass", "range", "place"])
            at += n

    order = ["pass", "dimensions", "key", "class"]
    ranges = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = map_batches(classes.select("class", "dimensions", "vector"), keys, "pass int, dimensions long, key long, class long").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranked = table(map_batches(ordered, number, "class long, pass int, range int, place long"), "ranks")
    # one row for each pass and range
    before = Window.partitionBy("pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("pass", "range").agg(F.count("*").alias("n"), F.min("place").alias("first")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("pass", "range", "shift")
    block = F.floor((F.col("place") + F.col("shift")) / BLOCK).cast("int")
    return ranked.join(F.broadcast(starts), ["pass", "range"]).groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", block.alias("block")))), lambda x: x["block"]).alias("blocks"))


def least_reached(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least row that each row and each column is connected with; every row and column has a true cell."""
    rows = np.arange(len(near))
    while True:
        columns = np.where(near, rows[:, None], len(near)).min(0)
        lower = np.minimum(rows, np.where(near, columns, len(near)).min(1))
        if (lower == rows).all():
            return rows, columns
        rows = lower


def compared_within(members: DataFrame, kind: str, least_cosine: float) -> DataFrame:
    """(a, b, links): all vectors with the same label (label, class, vector, copies) compared with each other. Rows with a = b have
    a part of the links of a vector, the others are edges that connect what is near.

    In a large label the vectors within half the largest angle of one of them (its core) are all linked, by the triangle's inequality: their links
    are a sum. Only the others are compared, with all. So a group of near copies costs what it has rows; what grows with its square is vectors
    that hang together by chains.
    """
    large = members.groupBy("label").agg(F.count("*").alias("members")).filter(F.col("members") > CHUNK).select("label")
    # at most one row for each CHUNK members
    marked = members.join(F.broadcast(large.withColumn("large", F.lit(True))), "label", "left")
    few = marked.filter("large is null").select("label", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), F.lit(False).alias("tied"), "class", "vector", "copies")
    many = table(marked.filter("large").drop("large"), "large")
    half = acos(least_cosine) / 2 - 1e-7

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = (unit(batch.column(2).to_pylist(), kind) * unit(batch.column(4).to_pylist(), kind)).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(np.arccos(np.clip(cosine, -1, 1)) <= half, pa.bool_())], ["label", "class", "vector", "copies", "to", "tied"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            side, tied = group.column(3).to_numpy(), group.column(4).to_numpy()
            cls, copies = group.column(5).to_numpy(), group.column(7).to_numpy().astype(np.float64)
            x, links = unit(group.column(6).to_pylist(), kind), np.zeros(group.num_rows)
            whole = side[0] == 2
            mine, there = (np.arange(len(side)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            near = x[mine] @ x[there].T >= least_cosine
            near &= cls[mine][:, None] != cls[there]
            rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(rows):
                continue
            near, mine, there = near[np.ix_(rows, columns)], mine[rows], there[columns]
            links[mine] += near @ copies[there]
            if not whole:
                # two rows outside the core meet twice, once from each side
                links[there] += np.where(tied[there], near.T @ copies[mine], 0.0)
            up, across = least_reached(near)
            some = np.flatnonzero(links)
            a = np.concatenate([cls[some], cls[mine[up]], cls[mine[across]]])
            b = np.concatenate([cls[some], cls[mine], cls[there]])
            n = np.concatenate([links[some], np.zeros(len(mine) + len(there))]).astype(np.int64)
            keep = (a != b) | (n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64()), pa.array(n[keep], pa.int64())], ["a", "b", "links"])

    dealt, inside = few, None
    if many.limit(1).count():
        stand = many.groupBy("label").agg(F.min(F.struct(F.xxhash64(F.lit("stand"), "class").alias("lot"), "class", "vector")).alias("one")).select("label", F.col("one.vector").alias("stand"), F.col("one.class").alias("to"))
        found = table(map_batches(many.join(stand, "label").select("label", "class", "vector", "copies", "stand", "to"), core, "label long, class long, vector binary, copies long, to long, tied boolean"), "core")
        together = found.filter("tied").groupBy("label").agg(F.sum("copies").alias("all"))
        tied = found.filter("tied").join(together, "label")
        inside = tied.select(F.col("class").alias("a"), F.col("class").alias("b"), (F.col("all") - F.col("copies")).alias("links")).unionByName(tied.filter("class != to").select(F.col("to").alias("a"), F.col("class").alias("b"), F.lit(0).cast("long").alias("links")))
        dealt = dealt.unionByName(deal(found, "label", CHUNK, ["tied", "class", "vector", "copies"]))
    dealt = dealt.select("label", "i", "j", "side", "tied", "class", "vector", "copies").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "class")
    out = map_batches(dealt, compare, "a long, b long, links long")
    return table(out if inside is None else out.unionByName(inside), "compared")


def near_vectors(vectors: DataFrame, least_cosine: float = 0.9, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row for each vector: id, n_links (other vectors of the component with cosine >= least_cosine), component_id (smallest id reachable) and kept.

    Null, zero or non-finite vectors link with nothing and stay by themselves; vectors of different lengths don't link.
    Equal vectors link. A null id takes the smallest id of its component. An empty table gives an empty table.
    """
    found, kind = classify(vectors, id_column, vector_column)
    rows = table(found, "vectors")
    classes = table(rows.filter("class is not null").groupBy("class").agg(F.first("dimensions").alias("dimensions"), F.first("vector").alias("vector"), F.min("id").alias("own_id"), F.count("*").alias("copies")), "classes")
    centre = centres(classes, kind)
    passes, whole = plan(classes, kind, centre, least_cosine, seed)
    placed = table(places(classes, kind, passes, seed, centre).join(classes, "class"), "placed")
    # a task has some blocks and the one after them
    dealt = placed.select("*", F.posexplode("blocks").alias("pass", "block")).withColumn("own", F.floor(F.col("block") / BLOCKS_A_TASK).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.when((F.col("block") % BLOCKS_A_TASK == 0) & (F.col("block") > 0), F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    dealt = dealt.select("pass", "group", "block", "dimensions", "class", "vector").repartition("pass", "group").sortWithinPartitions("pass", "group", "block", "dimensions", "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            n = group.num_rows
            block, size, cls = (group.column(k).to_numpy() for k in (2, 3, 4))
            raw = group.column(5).to_pylist()
            forest = Forest(n)
            for d in np.unique(size).tolist():
                of = np.flatnonzero(size == d)
                x, b = unit([raw[k] for k in of], kind), block[of]
                for one in np.unique(b).tolist():
                    mine = np.flatnonzero(b == one)
                    # the block after a task's own ones is compared with them only, its own task does the rest
                    if one // BLOCKS_A_TASK != group.column(1)[0].as_py():
                        continue
                    for other in (one, one + 1):
                        there = mine if other == one else np.flatnonzero(b == other)
                        if not len(there):
                            continue
                        u, v = np.nonzero(x[mine] @ x[there].T >= least_cosine)
                        for s, t in zip(of[mine[u]].tolist(), of[there[v]].tolist()):
                            forest.join(s, t)
            first = np.array([forest.find(k) for k in range(n)])
            tied = np.flatnonzero(first != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(cls[first[tied]], pa.int64()), pa.array(cls[tied], pa.int64())], ["a", "b"])

    edges = table(map_batches(dealt, compare, "a long, b long"), "links")
    if whole:
        hard = classes.filter(F.col("dimensions").isin(whole))
        edges = edges.union(compared_within(hard.withColumn("label", F.col("dimensions")), kind, least_cosine).filter("a != b").select("a", "b"))
    linked = components(edges)
    inside = compared_within(classes.join(linked, F.col("class") == F.col("node")).select("label", "class", "vector", "copies"), kind, least_cosine)
    degrees = inside.filter("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    several = classes.select("class", "own_id").join(linked, F.col("class") == F.col("node")).select("class", "label", "own_id")
    several = several.join(several.groupBy("label").agg(F.min("own_id").alias("first_id")), "label").select("class", "first_id")
    known = classes.select("class", "own_id", "copies").join(degrees, "class", "left").join(several, "class", "left").select("class", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first_id", "own_id").alias("first_id"))
    to = F.coalesce("first_id", "id")
    known = table(known, "known")
    return attach(rows.select("id", "class"), known, "class", "copies").select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), to.alias("component_id"), F.col("id").eqNullSafe(to).alias("kept"))
