"""The generator, the sinks, partition pruning and provenance."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dims, scd2, staging
from tidemark.operators.relational import fingerprint
from tidemark.sources import generator, reports
from tidemark.sources.tables import Store, load, read_tsv

SIZE = generator.Size(deals=3000, brokers=40, properties=100, months=18)


@pytest.fixture(scope="module")
def feeds(spark):
    return {n: f(spark, SIZE).cache() for n, f in generator.FEEDS.items()}


def test_feeds_are_alike_twice_and_hold_to_their_contracts(spark, feeds, tmp_path):
    for name, df in feeds.items():
        assert df.columns == generator.CONTRACTS[name] and {t for _, t in df.dtypes} == {"string"}
        assert fingerprint(df, df.columns).first() == fingerprint(generator.FEEDS[name](spark, SIZE).repartition(7), df.columns).first()
    counts = generator.write_feeds(spark, tmp_path.as_uri(), generator.Size(deals=200, months=6))
    assert counts["deal_submission"] >= 200 and read_tsv(spark, (tmp_path / "stage_event").as_uri(), generator.CONTRACTS["stage_event"]).count() == counts["stage_event"]


def test_defects_come_at_their_rates(feeds):
    s, e = feeds["deal_submission"], feeds["stage_event"]
    n, m = s.count(), e.count()
    near = lambda found, rate, of: abs(found - rate * of) <= 4 * (rate * of) ** 0.5 + 2
    r = generator.Rates()
    assert near(n - SIZE.deals, r.resubmitted, SIZE.deals)
    assert near(s.filter("deal_value_zar is null").count(), r.null_value, n)
    assert near(s.filter(F.col("deal_value_zar").isin(generator.BAD_VALUES)).count(), r.bad_value, n)
    assert near(s.filter(F.col("received_ts").isin(generator.BAD_DATES)).count(), r.bad_date, n)
    assert near(s.filter("property_nk is null").count(), r.name_only, n)
    assert near(e.filter(F.col("stage_code").isin(generator.BAD_STAGES)).count(), r.unknown_stage, m)
    assert near(m - e.select("source_event_nk").distinct().count(), r.redelivered, m)
    assert near(e.filter(F.substring("event_ts", 1, 4).isin("2019", "2031")).count(), r.out_of_range, m)


def test_feeds_go_through_staging_and_dimensions(spark, feeds):
    s = feeds["deal_submission"].withColumn("line", F.monotonically_increasing_id())
    c = staging.classify(s, "received_ts", "deal_value_zar", ["sector_hint"])
    landed = {"staged": staging.staged(c, "received_ts", "deal_value_zar"), "rejected": staging.rejects(c, ["line"], ["deal_value_zar"])}
    assert staging.reconciliation(s, landed).first()["difference"] == 0
    e = feeds["stage_event"].withColumn("line", F.monotonically_increasing_id())
    staged = staging.stage_events(e, dims.dim_stage(spark), ["line"], "source_event_nk", "stage_code", "event_ts")
    assert {r["reason"] for r in staged.select("reason").distinct().collect()} == {None, "redelivery", "unknown_stage"}
    b = feeds["broker_directory"].withColumn("line", F.monotonically_increasing_id()).withColumn("at", F.col("snapshot_date").cast("date"))
    dim = scd2.versions(b, "broker_nk", "at", ["agency_code", "broker_tier"], "line", ["broker_email"])
    assert scd2.violations(dim, "broker_nk").count() == 0 and dim.count() > dim.select("broker_nk").distinct().count() == b.select("broker_nk").distinct().count()
    p = feeds["property_register"].withColumn("line", F.monotonically_increasing_id()).withColumn("at", F.col("effective_date").cast("date"))
    assert scd2.violations(scd2.versions(p, "property_nk", "at", ["sector", "building_grade"], "line"), "property_nk").count() == 0


def test_partitioned_fact_is_pruned_at_plan_time_and_at_run_time(spark, sf_dir, tmp_path):
    from tidemark.operators.facts import event_month

    store = Store(spark, tmp_path.as_uri())
    li = load(spark, sf_dir, "lineitem")
    fact = store.write(li.withColumn("event_month", event_month(F.col("l_shipdate").cast("date"), "1995-06", "2001-05")), "mart", "fct", partition_by=["event_month"])
    pruned = fact.filter(F.col("event_month").isin("1998-01", "1998-02"))
    facts = reports.plan_facts(pruned)
    assert "event_month" in facts["partition_filters"][0]
    want = li.filter("l_shipdate >= timestamp_ntz'1998-01-01' and l_shipdate < timestamp_ntz'1998-03-01'").count()
    assert pruned.count() == want and pruned.select(F.input_file_name()).distinct().count() == 2
    months = store.write(spark.createDataFrame([("1998-01", "x"), ("1998-02", "x"), ("1999-01", "y")], "m string, kind string"), "mart", "months").filter("kind = 'x'")
    dynamic = fact.join(F.broadcast(months), F.col("event_month") == F.col("m"))
    assert "dynamicpruning" in dynamic._jdf.queryExecution().executedPlan().toString() and dynamic.count() == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>", None)], "k int, v string, n int")
    reports.write_page(tmp_path / "page.html", "Results", {"q": df})
    assert "&lt;b&gt;" in (tmp_path / "page.html").read_text()
    reports.write_ledger(tmp_path / "ledger.json", rows={"a": 1}, seconds=0.5)
    assert json.loads((tmp_path / "ledger.json").read_text()) == {"rows": {"a": 1}, "seconds": 0.5}
    assert "== Physical Plan ==" in reports.plan_text(df)


def test_fixtures_are_rebuilt_only_for_another_source(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri())
    one, two = spark.range(5), spark.range(6)
    assert reports.fixture(store, "f", one, ["id"], lambda s: one)[1]
    assert not reports.fixture(store, "f", one, ["id"], lambda s: one)[1]
    table, built = reports.fixture(store, "f", two, ["id"], lambda s: two)
    assert built and table.count() == 6
