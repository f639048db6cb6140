"""Bottom-k sketches of shingle hashes, in SQL functions only.

A sketch is the sorted array of the k least distinct 63-bit hashes of a text's shingles of five lower-cased words.
Sketches of parts merge into the sketch of the whole. Sets with fewer than k shingles are kept whole, so what is
said about them is exact.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

K, WIDTH = 256, 5
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Ranges of ids that documents are dealt into to find each one's successor: a range grows with the table beyond RANGES * ROWS_A_RANGE rows.
RANGES, ROWS_A_RANGE = 65_536, 500


def word_hashes(text: Column) -> Column:
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))


def shingle_hashes(h: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of shingles; fewer words than `width` are one shingle, with their number, none are none."""
    top = F.lit(-(2**63))  # the first bit is set, so that all have 16 hexadecimal digits
    many = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]).bitwiseOR(top))
    return F.when(F.size(h) == 0, h).when(F.size(h) < width, F.array(F.xxhash64(h, F.size(h)).bitwiseOR(top))).otherwise(F.array_distinct(many))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Adds the sketch of a text column. Word hashes are a column of their own, so that they are computed once."""
    return df.withColumn(f"__{name}", word_hashes(F.col(text))).withColumn(f"__{name}_shingles", shingle_hashes(F.col(f"__{name}"))).withColumn(name, bottom(F.col(f"__{name}_shingles"), k)).drop(f"__{name}", f"__{name}_shingles")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, merged: Column) -> Column:
    """Jaccard similarity from two sketches and their merged sketch; two empty sets are alike, an empty and another one aren't.

    merged should be a column of its own: it is used twice. Of what it has, the share that both have is the estimate.
    """
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), merged)) / F.size(merged))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**63
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, merged: Column, k: int = K) -> Column:
    """How much of the first set is in the second: the intersection, by resemblance times the union, over the first. An empty first set is contained."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, merged) * distinct_shingles(merged, k) / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.hex(x)), "")))


def placed(docs: DataFrame, column: str) -> Column:
    """A number that grows with the id (not strictly), whatever its type: of texts, the first seven bytes behind what all have in common."""
    kind = docs.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.StringType | T.BinaryType):
        ends = docs.agg(F.hex(F.min(c.cast("binary"))).alias("a"), F.hex(F.max(c.cast("binary"))).alias("b")).first()
        same = len(os.path.commonprefix([ends["a"] or "", ends["b"] or ""])) // 2
        # of shorter ids the missing bytes are the least
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), same + 1, 7)), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType | T.TimestampType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("double")
    return c.cast("double")


def with_range(docs: DataFrame, column: str) -> DataFrame:
    """Adds __range, the range that an id falls into. Bounds are quantiles; null ids have a range of their own, the last.

    There are as many ranges as rows ask for, up to RANGES: a list of their bounds, half a megabyte at most, goes to all tasks.
    """
    keyed = docs.withColumn("__place", placed(docs, column))
    n = docs.count()
    wanted = min(RANGES, max(1, n // ROWS_A_RANGE))
    if wanted == 1:
        return keyed.withColumn("__range", F.col(column).isNull().cast("int")).drop("__place")
    bounds = keyed.agg(F.sort_array(F.array_distinct(F.percentile_approx("__place", [k / wanted for k in range(1, wanted)], 4 * wanted))).alias("__bounds"))
    # one row: a list of lists, so that an id is compared with few bounds
    step = max(1, int(wanted**0.5))
    lists = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__bounds"), F.lit(1)), F.lit(step)), lambda k: F.slice("__bounds", k, step))
    bounds = table(bounds.select(lists.alias("__lists"), F.transform(lists, lambda x: F.get(x, F.lit(0))).alias("__firsts"), F.size("__bounds").alias("__all")), "bounds")
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col("__place")))
    coarse = F.greatest(below(F.col("__firsts")) - 1, F.lit(0))
    out = keyed.crossJoin(F.broadcast(bounds)).withColumn("__list", coarse)  # one row
    own = F.col("__list") * step + below(F.get("__lists", F.col("__list")))
    return out.withColumn("__range", F.when(F.col("__place").isNull(), F.col("__all") + 1).otherwise(own)).drop("__place", "__lists", "__firsts", "__all", "__list")


def with_next(docs: DataFrame, columns: list[str], id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, WindowSpec]:
    """Adds next_<column> of the document that follows by ascending id (null ids last, equal ids by text hash, after the last the first).

    Documents are dealt into ranges of ids; the first of each range is also dealt to the range before it, as the
    last there. So no window is larger than a range. Also returns the window.
    """
    order = [F.col(id_column).asc_nulls_last(), F.col("__hash")]
    keyed = with_range(docs, id_column).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    light = keyed.groupBy("__range").agg(F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "__hash")).alias("first"))
    # one row for each range, RANGES + 1 at most
    before = F.lag("__range").over(Window.partitionBy().orderBy("__range"))
    last = F.max("__range").over(Window.partitionBy())
    firsts = table(light.select(F.col("__range").alias("__own"), F.coalesce(before, last).alias("__before"), "first"), "ranges")
    own = keyed.join(F.broadcast(firsts), F.col("__range") == F.col("__own"))
    is_first = F.col(id_column).eqNullSafe(F.col("first.id")) & (F.col("__hash") == F.col("first.__hash"))
    dealt = own.withColumn("__to", F.explode(F.when(is_first, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("late")), F.struct(F.col("__before").alias("r"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("late"))))))
    dealt = dealt.select(*docs.columns, "__hash", F.col("__to.r").alias("__r"), F.col("__to.late").alias("__late"))
    window = Window.partitionBy("__r").orderBy("__late", *order)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}), window


def fingerprints(docs: DataFrame, k: int = K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Sketches of each text and of its edited text, and their likeness.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document. Null texts count as empty. Empty texts have an empty fingerprint; two of them are alike (1.0), one and
    another text are not (0.0). A table of one row is its own successor. An empty table gives an empty table.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles and edited_contained (how much of
    the text is in the edited one).
    """
    light = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows, window = with_next(light, ["text"], "id", "text")
    rows = with_sketch(rows, "text", "own", k).withColumn("next_own", F.lead("own").over(window)).filter("__late = 0")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.left(F.coalesce("next_text", F.lit("")), cut))})
    rows = with_sketch(rows.drop("text", "next_text"), "edited", "other", k)
    own, other, after = F.col("own"), F.col("other"), F.col("next_own")
    rows = rows.withColumns({"merged": merge(own, other, k), "merged_next": merge(own, after, k)})
    return rows.select(
        F.col("id").alias(id_column),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(own, other, F.col("merged")).alias("near_edited"),
        resemblance(own, after, F.col("merged_next")).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
        containment(own, other, F.col("merged"), k).alias("edited_contained"),
    )
