"""The build, its rules seen passing and failing, incremental loads, sources and streams."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.plans import quality, warehouse
from tidemark.plans.control import RunContext, incremental_load
from tidemark.sources.tables import ContractError, Store, read_tsv, with_ingest, write_tsv
from tidemark.streaming import incremental


@pytest.fixture(scope="module")
def tables(spark):
    return warehouse.build(spark, "/root/testdata/sf0.01")


def verdicts(df):
    return {r["code"]: r["verdict"] for r in df.collect()}


def test_all_rules_are_there():
    assert len(quality.GATE) == 12 and len(quality.STAGING) == 21 and len(quality.WAREHOUSE) == 30
    assert all(r.enabled for r in quality.GATE + quality.STAGING + quality.WAREHOUSE)
    codes = [r.code for r in quality.WAREHOUSE]
    assert codes == sorted(codes) and len(set(codes)) == 30


def test_the_build_passes_its_gate(spark, tables):
    results = quality.gate(spark, tables)
    quality.enforce(results)
    bad = {c: v for c, v in verdicts(quality.assertions(spark, "warehouse", tables)).items() if v not in ("PASS", "SKIPPED")}
    assert set(bad) <= {"WH-014", "WH-016", "WH-028"}
    assert quality.assertions(spark, "staging", tables).filter("verdict = 'ERROR'").count() == 0


def test_probes_make_only_what_they_read(spark, tmp_path):
    from tidemark.plans import probes

    (tmp_path / "sf").symlink_to("/root/testdata/sf0.001")  # a path that nothing is built of yet
    where = str(tmp_path / "sf")
    assert probes.probe_property_shape(spark, where).count() == 4 and probes.probe_submission_ledger(spark, where).count() == 10
    assert set(warehouse.built(spark, where)._made) == {"raw_submission", "raw_property"}
    assert probes.probe_event_defects(spark, where).count() == 5
    assert set(warehouse.built(spark, where)._made) == {"raw_submission", "raw_property", "raw_event", "arrived", "dim_stage"}


def folder_bytes(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return sum(f.stat().st_size for f in root.rglob("*") if f.is_file())


def test_what_the_batteries_keep_is_within_four_times_their_input(spark, tmp_path):
    (tmp_path / "sf").symlink_to("/root/testdata/sf0.1")
    where, before = str(tmp_path / "sf"), folder_bytes(spark)
    assert set(verdicts(quality.dq_gate(spark, where)).values()) <= {"PASS", "FAIL"}
    read = sum(Path(f"/root/testdata/sf0.1/{t}.parquet").stat().st_size for t in ("orders", "lineitem", "part"))
    assert folder_bytes(spark) - before < 4 * read


BREAKS = {
    "DQ-001": ("reject", lambda d: d.limit(0)), "DQ-003": ("int_deal", lambda d: d.unionByName(d)), "DQ-004": ("fct_pipeline", lambda d: d.limit(5)), "DQ-006": ("dim_broker", lambda d: d.withColumn("is_current", F.lit(True))),
    "DQ-009": ("fct_pipeline", lambda d: d.withColumn("value", -F.col("value"))), "DQ-002": ("int_deal", lambda d: d.withColumn("broker", F.lit(None).cast("long"))), "DQ-005": ("dim_broker", lambda d: d.withColumn("valid_to", F.col("valid_from"))), "DQ-008": ("partition_statistics", lambda d: d.withColumn("has_statistics", F.lit(False))), "DQ-007": ("dim_stage", lambda d: d.withColumn("is_terminal", F.lit(True))),
}
BREAKS_WH = {
    "WH-029": ("partition_statistics", lambda d: d.withColumn("rows", F.col("rows") + 1)),
    "WH-001": ("dim_broker", lambda d: d.withColumn("is_current", F.lit(False))), "WH-002": ("dim_broker", lambda d: d.withColumn("valid_to", F.lit("9999-12-31").cast("timestamp_ntz"))), "WH-003": ("dim_broker", lambda d: d.filter("broker_sk % 5 != 2")), "WH-008": ("dim_property", lambda d: d.filter("property_sk != -1")),
    "WH-011": ("dim_date", lambda d: d.limit(10)), "WH-012": ("fct_pipeline", lambda d: d.unionByName(d)), "WH-020": ("fct_pipeline", lambda d: d.withColumn("is_open", F.lit(True))), "WH-022": ("fct_event", lambda d: d.withColumn("event_month", F.lit("1990-01"))), "WH-024": ("fct_event", lambda d: d.withColumn("event_date_sk", F.lit(1))),
    "WH-025": ("fct_event", lambda d: d.unionByName(d)), "WH-026": ("dim_stage", lambda d: d.withColumn("stage_order", F.lit(1))), "WH-027": ("fct_event", lambda d: d.limit(0)), "WH-018": ("fct_pipeline", lambda d: d.withColumn("received_ts", F.lit("9999-01-01").cast("timestamp_ntz"))), "WH-019": ("fct_pipeline", lambda d: d.withColumn("offer_ts", F.lit("1901-01-01").cast("timestamp_ntz"))), "WH-030": ("fct_pipeline", lambda d: d.withColumn("broker_sk", F.lit(-1))), "WH-023": ("fct_event", lambda d: d.withColumn("event_month", F.lit("__DEFAULT__"))),
}


@pytest.mark.parametrize("code", sorted(BREAKS))
def test_gate_rules_fail_on_what_they_watch(spark, tables, code):
    name, harm = BREAKS[code]
    results = quality.gate(spark, tables | {name: harm(tables[name])}, rules=[r for r in quality.GATE if r.code == code])
    assert verdicts(results)[code] == "FAIL"
    with pytest.raises(quality.GateFailed):
        quality.enforce(results)


@pytest.mark.parametrize("code", sorted(BREAKS_WH))
def test_assertions_fail_on_what_they_watch(spark, tables, code):
    name, harm = BREAKS_WH[code]
    rules = [r for r in quality.WAREHOUSE if r.code == code]
    r = quality.run_rules(spark, rules, tables | {name: harm(tables[name])}, True, as_of="2001-08-01", first_month="1995-01", last_month="2001-06").first()
    assert r["verdict"] == "FAIL" and r["sample"].startswith("[{")


def test_a_rule_that_breaks_is_an_error_and_the_others_run(spark, tables):
    rules = [quality.Rule("A", "int", "error", "", "SELECT count(*) AS n FROM {nowhere}"), quality.Rule("B", "int", "error", "", "SELECT cast('x' AS int) AS n"), quality.GATE[2]]
    assert verdicts(quality.run_rules(spark, rules, tables, False)) == {"A": "ERROR", "B": "ERROR", "DQ-003": "PASS"}


def test_another_star_is_checked_by_its_own_tables(spark, tables):
    lab = {f"lab.{k}": v for k, v in tables.items() if k.startswith(("dim_", "fct_"))}
    lab["lab.fct_pipeline"] = lab["lab.fct_pipeline"].unionByName(lab["lab.fct_pipeline"])
    assert verdicts(quality.assertions(spark, "warehouse", tables | lab))["WH-012"] == "PASS"
    assert verdicts(quality.assertions(spark, "warehouse", tables | lab, star="lab"))["WH-012"] == "FAIL"
    del lab["lab.dim_date"]
    assert verdicts(quality.assertions(spark, "warehouse", tables | lab, star="lab"))["WH-011"] == "ERROR"
    with pytest.raises(ValueError):
        quality.assertions(spark, "warehouse", tables, star="lab; drop")


def test_a_crash_before_the_pointer_leaves_the_old_table(spark, tmp_path, monkeypatch):
    store = Store(spark, tmp_path.as_uri())
    store.write(spark.range(3), "mart", "t")
    monkeypatch.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        store.write(spark.range(5), "mart", "t")
    monkeypatch.undo()
    assert store.read("mart", "t").count() == 3
    # two writers that start from the same table: one of them fails
    number = store._pointers("mart", "t")[-1]
    store.write(spark.range(4), "mart", "t")
    with pytest.raises(ContractError):
        store._point("mart", "t", ["nowhere"], number)
    assert store.read("mart", "t").count() == 4
    for _ in range(12):
        store.write(spark.range(1), "mart", "t")
    assert len(store._pointers("mart", "t")) == 10


def landing(spark, ids, day):
    return spark.createDataFrame([(i, f"v{i}", datetime(2024, 1, day)) for i in ids], "k int, v string, ingested_at timestamp_ntz")


def test_watermarks_only_go_forward_and_replays_write_nothing(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri())
    assert incremental_load(store, landing(spark, range(5), 2), "s", ("int", "t"), ["k"]) == 5
    both = landing(spark, range(5), 2).union(landing(spark, range(3, 9), 3))
    assert incremental_load(store, both, "s", ("int", "t"), ["k"]) == 4
    assert incremental_load(store, both, "s", ("int", "t"), ["k"]) == 0
    assert incremental_load(store, landing(spark, [99], 1), "s", ("int", "t"), ["k"]) == 0  # older than the mark
    with pytest.raises(RuntimeError):
        incremental_load(store, landing(spark, [50], 9), "s", ("int", "t"), ["k"], check=lambda d: (_ for _ in ()).throw(RuntimeError("gate")))
    context = RunContext(store, ("s",))
    assert context.watermark("s") == datetime(2024, 1, 3) and context.mode == "incremental"
    runs = {r["run_id"]: r["status"] for r in store.read("meta", "load_run").collect()}
    assert runs == {1: "SUCCESS", 2: "SUCCESS", 3: "SUCCESS", 4: "SUCCESS", 5: "FAILED", 6: "RUNNING"}


def test_store_replaces_a_table_that_it_is_computed_from(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri())
    store.write(spark.range(3), "mart", "t")
    store.write(store.read("mart", "t").withColumn("id", F.col("id") + 10), "mart", "t")
    store.write(spark.range(1), "mart", "t", mode="append")
    assert sorted(r["id"] for r in store.read("mart", "t").collect()) == [0, 10, 11, 12]
    with pytest.raises(ContractError):
        store.write(spark.range(1), "mart", "t", mode="new")


def test_text_feeds_keep_nulls_and_hold_to_their_contract(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b\"q", "x y"), ("c", "\\N?")], "k string, v string").coalesce(1)
    path = (tmp_path / "feed").as_uri()
    write_tsv(df, path)
    assert sorted(map(str, read_tsv(spark, path, ["k", "v"]).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ContractError):
        read_tsv(spark, path, ["k", "w"])
    assert with_ingest(df, "b1", "2024-01-01", "f", "k").columns[-5:] == ["source_batch_id", "ingested_at", "source_file", "raw_line_no", "payload_hash"]


def test_a_stream_in_two_drains_is_the_batch(spark, tmp_path):
    store = Store(spark, (tmp_path / "store").as_uri())
    landed, mark = (tmp_path / "in").as_uri(), (tmp_path / "mark").as_uri()
    schema = landing(spark, [1], 1).schema
    landing(spark, range(4), 1).write.parquet(landed)
    incremental.drain(incremental.landing_stream(spark, landed, schema), incremental.append_once(store, "int", "t", ["k"]), mark)
    landing(spark, range(2, 7), 2).write.mode("append").parquet(landed)
    for _ in range(2):
        incremental.drain(incremental.landing_stream(spark, landed, schema), incremental.append_once(store, "int", "t", ["k"]), mark)
    assert sorted(r["k"] for r in store.read("int", "t").collect()) == list(range(7))
    counts = incremental.windowed_counts(landing(spark, range(3), 1), "ingested_at", "v")
    assert counts.count() == 3


def test_plans_are_the_ones_wanted(spark, sf_dir):
    from tidemark.plans import performance

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan(performance.case1_rewrite(spark, sf_dir)) and "GreaterThanOrEqual(l_shipdate" not in plan(performance.case1_naive(spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_shipdate" in plan(performance.case2_entity(spark, sf_dir))
    assert "Python" not in plan(performance.case3_dwell(spark, sf_dir))
