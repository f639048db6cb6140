"""Relational building blocks that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in an order that must be total."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def small(dim: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a relation that has at most `rows` rows, checked by reading no more than that; larger ones are left to the planner."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def point_in_time(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, at: str, sk: str, valid_from: str = "valid_from", valid_to: str = "valid_to", name: str | None = None, known: Column | None = None, take: dict[str, str] | None = None) -> DataFrame:
    """Adds the surrogate key of the version in force at a time, or -1. The natural key is an equality, so the range is only a residue of a hash or merge join.

    known: facts for which it is false aren't looked up. take: attributes of the version that come along (null without one), by the name that
    they get, so that the dimension needn't be joined again by its key.
    """
    d = dim.select(F.col(dim_key).alias("__k"), F.col(sk).alias("__sk"), F.col(valid_from).alias("__f"), F.col(valid_to).alias("__t"), *[F.col(c).alias(n) for n, c in (take or {}).items()])
    on = (F.col(fact_key) == F.col("__k")) & (F.col(at) >= F.col("__f")) & (F.col(at) < F.col("__t"))
    if known is not None:
        on = on & known
    return fact.join(d, on, "left").withColumn(name or sk, F.coalesce("__sk", F.lit(-1))).drop("__k", "__sk", "__f", "__t")


def latest_before(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, at: str, dim_at: str, row: Sequence[str], take: Sequence[str], tie: Sequence[Column] = ()) -> DataFrame:
    """Adds columns of the latest dim row of the same key at or before a time; null where there is none.

    Both sides are one ordered stream for each key, with the last seen dim row carried on, so no fact meets more than one row: there is
    no intermediate of all earlier rows. row: the fact's own key, for ties among facts.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    kind = dim.select(*take).schema
    empty = F.lit(None).cast(kind)
    d = dim.select(F.col(dim_key).alias("__k"), F.col(dim_at).alias("__at"), F.lit(0).alias("__side"), payload.alias("__dim"), F.lit(None).cast(fact.schema).alias("__fact"), *[t.alias(f"__tie{k}") for k, t in enumerate(tie)])
    f = fact.select(F.col(fact_key).alias("__k"), F.col(at).alias("__at"), F.lit(1).alias("__side"), empty.alias("__dim"), F.struct("*").alias("__fact"), *[F.lit(None).cast(d.schema[f"__tie{k}"].dataType).alias(f"__tie{k}") for k in range(len(tie))])
    order = Window.partitionBy("__k").orderBy("__at", "__side", *[F.col(f"__tie{k}") for k in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
    merged = d.unionByName(f).withColumn("__dim", F.last("__dim", ignorenulls=True).over(order)).filter("__side = 1")
    return merged.select(*[F.col(f"__fact.{c}").alias(c) for c in fact.columns], *[F.col(f"__dim.{c}").alias(c) for c in take])


def current_of_version(fact: DataFrame, dim: DataFrame, sk: str, nk: str, take: Sequence[str], current: str = "is_current") -> DataFrame:
    """From a version's key to its natural key to the current version: adds `take` of the current version.

    A fact's key is a version's key; joining it to current versions alone would lose the history.
    """
    versions = dim.select(F.col(sk).alias("__sk"), F.col(nk).alias("__nk"))
    now = dim.filter(F.col(current)).select(F.col(nk).alias("__now"), *[F.col(c).alias(f"__{c}") for c in take])
    joined = fact.join(versions, F.col(sk) == F.col("__sk")).join(now, F.col("__nk") == F.col("__now"))
    return joined.drop("__sk", "__nk", "__now", *[c for c in take if c in fact.columns]).withColumnsRenamed({f"__{c}": c for c in take})


def dense_grid(members: DataFrame, periods: DataFrame, activity: DataFrame, keys: Sequence[str], zeros: Sequence[str]) -> DataFrame:
    """Every member in every period, with zeros where nothing happened. The product has members x periods rows, which is the result's size; periods (months) go to all tasks if they are as few as that."""
    grid = members.crossJoin(small(periods))
    out = grid.join(activity, list(keys), "left")
    return out.fillna(0, subset=list(zeros))


def islands(df: DataFrame, keys: Sequence[str], month_index: str) -> DataFrame:
    """Runs of consecutive months: (keys, first, last, length) from distinct (keys, month number)."""
    seen = df.select(*keys, month_index).distinct()
    run = seen.withColumn("__run", F.col(month_index) - F.row_number().over(Window.partitionBy(*keys).orderBy(month_index)))
    return run.groupBy(*keys, "__run").agg(F.min(month_index).alias("first"), F.max(month_index).alias("last"), F.count("*").alias("length")).drop("__run")


def tree_paths(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """(root, node, depth, path, is_cycle) of every node below every root; a node that repeats on its path ends it, marked.

    Roots have a null parent or one that isn't in the relation; a cycle that no root leads to has no root and isn't walked. The depth is
    bounded by spark.sql.cteRecursionLevelLimit, beyond which the query fails.
    """
    e = edges.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    known = e.select(F.col("node").alias("known"))
    roots = e.join(known, F.col("up") == F.col("known"), "left_anti").select("node")
    return edges.sparkSession.sql(
        """WITH RECURSIVE t(root, node, depth, path, is_cycle) AS (
             SELECT node, node, 0, array(node), false FROM {roots}
             UNION ALL
             SELECT t.root, e.node, t.depth + 1, concat(t.path, array(e.node)), array_contains(t.path, e.node) FROM t JOIN {e} e ON e.up = t.node WHERE NOT t.is_cycle)
           SELECT * FROM t""",
        roots=roots,
        e=e,
    )


def merge_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, insert: dict[str, Column] | None = None) -> DataFrame:
    """The target after an upsert: matched rows take `update`, unmatched source rows `insert`, all others stay.

    Expressions name the sides `t` and `s`. Without them, matched and new rows take the source's values.
    """
    columns = target.columns
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = t.withColumn("__t", F.lit(True)).alias("t").join(s.withColumn("__s", F.lit(True)).alias("s"), on, "full")
    has_t, has_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()

    def value(c: str) -> Column:
        given = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        up = (update or {}).get(c, F.col(f"t.{c}") if update is not None or c not in source.columns else given)
        new = (insert or {}).get(c, given)
        return F.when(has_t & has_s, up).when(has_s, new).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c)

    return both.select(*[F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c) if c in keys else value(c) for c in columns])


def once(source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row for each key, the first in an order; without one, by all other columns, so that every run takes the same row."""
    others = [F.col(c).asc_nulls_last() for c in source.columns if c not in keys]
    return pick_first(source, keys, list(order) or others) if order or others else source.distinct()


def only_new(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Source rows whose key isn't in the target, one for each key: what an idempotent append writes. order: which one, such as by file and line."""
    return once(source, keys, order).join(target.select(*keys), list(keys), "left_anti")


def numbered(df: DataFrame, nk: str, order: Sequence[str], sk: str) -> DataFrame:
    """Numbers from 1 without gaps: by cells of the natural key's md5, within a cell by order. No task sees all rows, and only counts of cells are added up in one."""
    cells = df.withColumn("__cell", F.substring(F.md5(F.col(nk).cast("string").cast("binary")), 1, 3))
    before = Window.partitionBy().orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 cells
    sizes = cells.groupBy("__cell").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy(*order))
    return cells.join(F.broadcast(sizes), "__cell").withColumn(sk, (place + F.col("__start")).cast("long")).drop("__cell", "__n", "__start")


def ranks(df: DataFrame, value: str, tie: Sequence[str], tiles: int) -> DataFrame:
    """Adds rank, dense_rank, tied_peers and tile of all rows by a whole number, greatest first, nulls last. Windows without a key see one row for each value; rows
    are only ordered among those of equal value."""
    sizes = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__m"))
    down = Window.partitionBy().orderBy(F.desc_nulls_last("__v"))
    before = F.coalesce(F.sum("__m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__v", (before + 1).alias("rank"), F.row_number().over(down).alias("dense_rank"), (F.col("__m") - 1).alias("tied_peers"), F.sum("__m").over(Window.partitionBy()).alias("__all"))
    out = df.join(small(starts), F.col(value).eqNullSafe(F.col("__v"))).drop("__v")
    at = F.col("rank") + F.row_number().over(Window.partitionBy(value).orderBy(*tie)) - 1
    size, more = F.floor(F.col("__all") / tiles), F.col("__all") % tiles
    edge = more * (size + 1)  # the first tiles have one row more
    tile = F.when(F.col("__at") <= edge, F.ceil(F.col("__at") / (size + 1))).otherwise(more + F.ceil((F.col("__at") - edge) / size))
    return out.withColumn("__at", at).withColumn("tile", tile.cast("int")).drop("__at", "__all")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n, checksum): a sum of row hashes, which no order of rows changes."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary")), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(row).cast("decimal(38,0)").alias("checksum"))
