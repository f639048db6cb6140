"""Small fixtures with results worked out by hand, and properties."""

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import dedupe, dims, facts, relational, scd2, sequence, staging
from tidemark.plans.keep import kept

FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ts = lambda s: datetime.strptime(s, "%Y-%m-%d")


def test_scalars(spark):
    df = spark.createDataFrame([("  INDUSTRIAL",), ("Mixed  use ",), ("Erf 4821 Sandton (Pty) Ltd",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(S.squeeze(F.col("x"))).collect()] == ["INDUSTRIAL", "Mixed use", "Erf 4821 Sandton (Pty) Ltd", None, None]
    assert [r[0] for r in df.select(S.match_name(F.col("x"))).collect()] == ["industrial", "mixed use", "erf 4821 sandton", None, None]
    d = spark.createDataFrame([("2026-02-30",), ("31/02/2025",), ("yesterday",), ("2025-13-04",), ("0000-00-00",), ("2024-02-29 10:00",), (None,)], "x string")
    assert [r[0] for r in d.select(S.is_calendar_date(F.col("x"))).collect()] == [False, False, False, False, False, True, None]
    w = spark.createDataFrame([(date(2024, 12, 30),), (date(2021, 1, 3),)], "d date")
    assert [r[0] for r in w.select(S.iso_week(F.col("d"))).collect()] == ["2025-01", "2020-53"]
    # a null and a value in the next attribute don't hash alike
    h = spark.createDataFrame([("a", None), (None, "a")], "p string, q string").select(S.tracked_hash(["p", "q"])).collect()
    assert h[0][0] != h[1][0]


def snapshots(spark):
    rows = [("a", "2024-01-01", "x", "n1"), ("a", "2024-02-01", "x", "n2"), ("a", "2024-03-01", "y", "n3"), ("a", "2024-04-01", "x", "n4"), ("b", "2024-03-01", "x", "m1"), ("b", "2024-03-01", "z", "m2"), ("b", "2024-04-01", None, "m3")]
    return spark.createDataFrame([(k, date.fromisoformat(d), v, n, i) for i, (k, d, v, n) in enumerate(rows)], "k string, d date, v string, name string, line long")


def test_scd2_by_hand(spark):
    dim = scd2.versions(snapshots(spark), "k", "d", ["v"], "line", ["name"])
    got = {(r["k"], r["v"], str(r["valid_from"])[:10], str(r["valid_to"])[:10], r["is_current"], r["name"]) for r in dim.collect()}
    assert got == {("a", "x", "1900-01-01", "2024-03-01", False, "n4"), ("a", "y", "2024-03-01", "2024-04-01", False, "n4"), ("a", "x", "2024-04-01", "9999-12-31", True, "n4"), ("b", "x", "2024-03-01", "2024-04-01", False, "m3"), ("b", None, "2024-04-01", "9999-12-31", True, "m3")}
    assert scd2.violations(dim, "k").count() == 0
    broken = dim.withColumn("valid_to", F.when(F.col("v") == "y", scd2.stamp("2024-05-01")).otherwise(F.col("valid_to")))
    assert [r["violation"] for r in scd2.violations(broken, "k").collect()] == ["overlap"]
    keys = [r["sk"] for r in scd2.with_keys(dim, "k", "sk").orderBy("sk").collect()]
    assert keys == [1, 2, 3, 4, 5]


@FAST
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 12), st.sampled_from(["x", "y", None])), min_size=1, max_size=20), st.integers(1, 12))
def test_scd2_in_two_batches_is_scd2_at_once(spark, rows, cut):
    data = [(k, date(2024, m, 1), v, i) for i, (k, m, v) in enumerate(rows)]
    feed = spark.createDataFrame(data, "k string, d date, v string, line long")
    show = lambda df: sorted(str((r["k"], r["v"], r["valid_from"], r["valid_to"], r["is_current"])) for r in df.collect())
    whole = scd2.versions(feed, "k", "d", ["v"], "line", anchor_first=False)
    early, late = feed.filter(F.month("d") < cut), feed.filter(F.month("d") >= cut)
    dim = scd2.versions(early, "k", "d", ["v"], "line", anchor_first=False)
    once = scd2.apply_batch(dim, late, "k", "d", ["v"], "line")
    assert show(once) == show(whole)
    assert show(scd2.apply_batch(once, late, "k", "d", ["v"], "line")) == show(whole)


def test_point_in_time_edges(spark):
    dim = scd2.with_keys(scd2.versions(snapshots(spark), "k", "d", ["v"], "line"), "k", "sk")
    fact = spark.createDataFrame([("a", ts("2024-03-01")), ("a", ts("1999-01-01")), ("b", ts("2024-02-29")), ("q", ts("2024-03-01"))], "k string, at timestamp_ntz")
    found = relational.point_in_time(fact, dim.withColumnRenamed("k", "nk"), "k", "nk", "at", "sk").join(dim.select("sk", "v"), "sk", "left")
    assert sorted((r["k"], str(r["at"])[:10], r["v"]) for r in found.collect()) == [("a", "1999-01-01", "x"), ("a", "2024-03-01", "y"), ("b", "2024-02-29", None), ("q", "2024-03-01", None)]


def test_latest_before(spark):
    dim = spark.createDataFrame([("a", 1, "one"), ("a", 5, "five"), ("a", 5, "tie")], "k string, t int, v string").withColumn("line", F.monotonically_increasing_id())
    fact = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 4), (4, "a", 9), (5, "b", 3)], "id int, k string, at int")
    got = relational.latest_before(fact, dim, "k", "k", "at", "t", ["id"], ["v"], [F.col("v")])
    assert {r["id"]: r["v"] for r in got.collect()} == {1: None, 2: "one", 3: "one", 4: "tie", 5: None}


def test_tree_with_cycles(spark):
    edges = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("s", "s"), ("o", "gone")], "n string, p string")
    got = {(r["root"], r["node"]): (r["depth"], r["is_cycle"]) for r in relational.tree_paths(edges, "n", "p").collect()}
    assert got == {("r", "r"): (0, False), ("r", "a"): (1, False), ("r", "b"): (2, False), ("r", "c"): (3, False), ("o", "o"): (0, False)}


def test_islands(spark):
    df = spark.createDataFrame([("a", m) for m in (1, 2, 3, 12, 13, 20)] + [("a", 2)], "k string, m int")
    assert sorted((r["first"], r["last"], r["length"]) for r in relational.islands(df, ["k"], "m").collect()) == [(1, 3, 3), (12, 13, 2), (20, 20, 1)]


def test_merge_and_append(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, relational.merge_rows(t, s, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(map(tuple, facts.append(t, s, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_snapshot_keeps_the_first_value_and_counts_revisions(spark):
    first = spark.createDataFrame([(1, 10, 0, 10), (2, None, 0, None)], "k int, value int, value_revision_count int, first_value int")
    later = spark.createDataFrame([(1, 11), (2, 5), (3, 7)], "k int, value int")
    once = facts.upsert_snapshot(first, later, "k", "value")
    want = [(1, 11, 1, 10), (2, 5, 1, None), (3, 7, 0, 7)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, facts.upsert_snapshot(once, later, "k", "value").collect())) == want
    assert sorted((r["k"], r["old_value"], r["new_value"]) for r in facts.restatements(first, later, "k", ["value"]).collect()) == [(1, "10", "11"), (2, None, "5")]


def brute_settle(events):
    """Deal by deal: drop what is impossible, look again."""
    out = []
    for deal in sorted({e[0] for e in events}):
        own = sorted((e for e in events if e[0] == deal), key=lambda e: (e[2], e[1]))
        while True:
            bad = {b[1] for a, b in zip(own, own[1:]) if a[3] >= 8 or b[3] <= a[3] - 2}
            if not bad:
                break
            own = [e for e in own if e[1] not in bad]
        out += [(deal, e[1], k + 1) for k, e in enumerate(own)]
    return sorted(out)


@FAST
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 10), st.integers(1, 10)), min_size=1, max_size=25))
def test_settling_is_a_fixed_point(spark, rows):
    data = [(d, i, datetime(2024, 1, day), s) for i, (d, day, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "deal int, line int, at timestamp_ntz, stage int").withColumns({"stage_order": F.col("stage"), "is_terminal": F.col("stage") >= 8})
    accepted, removed, _ = sequence.settle(df, "deal", "at", "line", "stage_order", "is_terminal", "stage", kept)
    assert sorted((r["deal"], r["line"], r["event_seq"]) for r in accepted.collect()) == brute_settle(data)
    assert accepted.count() + removed.count() == len(data)


def test_a_removal_that_makes_another_impossible(spark):
    data = [(1, 1, ts("2024-01-01"), 5), (1, 2, ts("2024-01-02"), 3), (1, 3, ts("2024-01-03"), 3)]
    df = spark.createDataFrame(data, "deal int, line int, at timestamp_ntz, stage int").withColumns({"stage_order": F.col("stage"), "is_terminal": F.lit(False)})
    accepted, removed, passes = sequence.settle(df, "deal", "at", "line", "stage_order", "is_terminal", "stage", kept)
    assert [r["line"] for r in accepted.collect()] == [1] and passes == 3 and sorted(r["pass"] for r in removed.collect()) == [1, 2]


def test_dedupe_across_a_year_end(spark):
    df = spark.createDataFrame([(1, "b", "p", ts("2024-12-30"), 100.0), (2, "b", "p", ts("2025-01-02"), 102.0), (3, "b", None, ts("2025-01-02"), 100.0), (4, "b", "p", ts("2024-12-30"), 90.0)], "id int, b string, p string, at timestamp_ntz, v double")
    df = df.withColumn("f", dedupe.block_key([F.col("b"), F.col("p")], F.col("at")))
    order = [F.col("at"), F.col("id")]
    assert sorted(r["id"] for r in dedupe.survivors(df, "f", order).collect()) == [1, 3]
    assert sorted((r["suppressed"], r["survivor"], r["days_after"], r["value_delta_pct"]) for r in dedupe.suppressed(df, "f", order, "id", "at", "v").collect()) == [(2, 1, 3.0, 2.0), (4, 1, 0.0, -10.0)]


def test_staging_lands_rejects_and_grades_every_row(spark):
    data = [(1, "2024-01-01", "150000"), (2, "2024-01-01", "-150000"), (3, "2024-01-01", "99999.99"), (4, "2024-01-01", None), (5, "yesterday", "1"), (6, "yesterday", "TBC"), (7, "2024-01-01", "TBC"), (8, None, "1"), (9, "2024-01-01", "100000.00")]
    raw = spark.createDataFrame(data, "line int, d string, v string")
    c = staging.classify(raw, "d", "v")
    s, r = staging.staged(c, "d", "v"), staging.rejects(c, ["line"], ["d", "v"])
    got = {x["line"]: x["q"] for x in s.select("line", staging.grade(F.col("value"), F.col("value_was_negative"), F.lit(False)).alias("q")).collect()}
    assert got == {1: "clean", 2: "repaired", 3: "suspect", 4: "suspect", 9: "clean"}
    assert {x["line"]: (x["reason"], x["payload"]) for x in r.collect()} == {5: ("unparseable_date", '{"d":"yesterday","v":"1"}'), 6: ("unparseable_date", '{"d":"yesterday","v":"TBC"}'), 7: ("unparseable_value", '{"d":"2024-01-01","v":"TBC"}'), 8: ("unparseable_date", '{"d":null,"v":"1"}')}
    assert staging.reconciliation(raw, {"staged": s, "rejected": r}).first()["difference"] == 0


def test_events_stage_once(spark):
    raw = spark.createDataFrame([("f", 1, "e1", " received ", "2024-01-01"), ("f", 2, "e1", "RECEIVED", "2024-01-01"), ("f", 3, "e2", "REVIEW", "2024-01-01"), ("f", 4, "e3", "OFFER", "never")], "file string, line int, e string, code string, t string")
    got = staging.stage_events(raw, dims.dim_stage(spark), ["file", "line"], "e", "code", "t")
    assert {r["line"]: r["reason"] for r in got.collect()} == {1: None, 2: "redelivery", 3: "unknown_stage", 4: "unparseable_time"}


def test_ranking_frames(spark):
    assert pytest.approx(1.0) == spark.range(1).select(S.ratio(F.lit(2), F.lit(2))).first()[0]
    assert spark.range(1).select(S.ratio(F.lit(2), F.lit(0))).first()[0] is None


def test_line_keys_tell_lines_of_very_many_orders_apart(spark):
    from tidemark.plans import composite

    rows = [(10**11, 1, 5 * 10**11, 9_999_999_999), (10**11, 1, 5 * 10**11 + 1, 1), (10**11, 2, 1, 1), (150_000_000, 7, 20_000_000, 1_000_000), (150_000_000, 7, 20_000_001, 0), (0, 1, 0, 10_000), (0, 1, 1, 0)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, k int").withColumn("line", composite.line_key())
    keys = {r["k"]: r["line"] for r in df.collect()}
    assert len(set(keys.values())) == len(rows)
    assert [k for k, _ in sorted(keys.items(), key=lambda x: x[1])] == [k for k, _ in sorted(enumerate(rows), key=lambda x: x[1])]


def test_type1_overwrites_matched_rows_only_and_with_nulls(spark):
    dim = spark.createDataFrame([("a", 1, "p", "x", "r"), ("b", 2, None, "x", None), ("c", 3, "p", "x", "r")], "k string, sk long, f string, g string, h string")
    latest = spark.createDataFrame([("b", None, "y", None), ("c", None, None, "s"), ("d", "n", None, None), ("e", None, None, None)], "k string, f string, g string, h string")
    out = {r["k"]: tuple(r)[1:] for r in dims.type1_upsert(dim, latest, "k", "sk", ["f", "g", "h"]).collect()}
    assert out["a"] == (1, "p", "x", "r") and out["b"] == (2, None, "y", None) and out["c"] == (3, None, None, "s")
    assert sorted((out["d"][0], out["e"][0])) == [4, 5] and out["d"][1:] == ("n", None, None)


def test_appends_keep_the_first_row_of_a_key(spark):
    target = spark.createDataFrame([(1, "f0", 1)], "k int, file string, line int")
    batch = spark.createDataFrame([(2, "f2", 1), (2, "f1", 9), (2, "f1", 3), (1, "f1", 1), (3, "f1", 1), (3, "f1", 1)], "k int, file string, line int").repartition(3)
    out = sorted(tuple(r) for r in relational.only_new(target, batch, ["k"], [F.col("file"), F.col("line")]).collect())
    assert out == [(2, "f1", 3), (3, "f1", 1)] == sorted(tuple(r) for r in relational.only_new(target, batch, ["k"]).collect())
    assert relational.only_new(target.select("k"), batch.select("k"), ["k"]).count() == 2


def test_short_lists_aren_t_cut(spark):
    many = spark.range(12_000).select(F.col("id").alias("period"))
    members = spark.createDataFrame([(1,)], "member long")
    activity = spark.createDataFrame([(1, 11_999, 5)], "member long, period long, n long")
    grid = relational.dense_grid(members, many, activity, ["member", "period"], ["n"])
    assert grid.count() == 12_000 and grid.agg(F.sum("n")).first()[0] == 5
    values = spark.range(1500).select(F.col("id").cast("string").alias("v"))
    assert dims.junk([(values, "v")], "sk").count() == 1501
    assert relational.small(values, 10)._jdf.queryExecution().optimizedPlan().toString().count("hint") == 0


@FAST
@given(st.lists(st.integers(0, 6) | st.none(), max_size=40), st.integers(1, 11))
def test_ranks_are_those_of_windows(spark, values, tiles):
    from pyspark.sql import Window

    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v long")
    w = Window.partitionBy().orderBy(F.desc_nulls_last("v"))
    want = df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "tied_peers": F.count("*").over(Window.partitionBy("v")) - 1, "tile": F.ntile(tiles).over(Window.partitionBy().orderBy(F.desc_nulls_last("v"), "k"))})
    assert sorted(map(tuple, relational.ranks(df, "v", ["k"], tiles).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
