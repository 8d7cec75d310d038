from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from silvermart import schemas
from silvermart.plans.pipeline import REFINED, run_pipeline
from silvermart.sources import feed
from silvermart.sources.landing import (
    ENTITIES,
    land_all,
    land_entity,
    land_with_rejects,
    read_source,
    read_with_rejects,
    stringify,
)
from silvermart.sources.store import TableStore, in_parallel, scratch_root
from tests.conftest import DATA, ORDER, rows_of


# -- landing ---------------------------------------------------------------------------------


def test_stringify_spells_missing_cells_out(spark):
    df = spark.createDataFrame(
        [
            (1, 2.5, None, datetime.date(2020, 1, 5), True),
            (None, float("nan"), "x", None, None),
        ],
        "i int, d double, s string, t date, b boolean",
    )
    assert rows_of(stringify(df)) == [
        ("1", "2.5", "nan", "2020-01-05", "True"), ("nan", "nan", "x", "NaT", "nan"),
    ]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_land_from_any_format(spark, store, tmp_path, fmt):
    people = next(e for e in ENTITIES if e.sheet == "People")
    rows = spark.createDataFrame([("Mia, the first", "East"), ("Max", None)], people.schema)
    source = str(tmp_path / fmt)
    rows.write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(source)
    table, report = land_entity(store, people, read_source(spark, fmt, source, people.schema))
    assert rows_of(store.open(table)) == [("Max", "nan"), ("Mia, the first", "East")]
    assert report == {
        "sheet": "People", "table": "raw_people", "rows": 2, "columns": 2, "path": table.path,
    }


def test_landing_takes_header_names_in_any_case(spark, store, tmp_path):
    lower = spark.createDataFrame([tuple(ORDER.values())], [c.lower() for c in ORDER])
    lower.write.parquet(str(tmp_path / "lower"))
    source = read_source(spark, "parquet", str(tmp_path / "lower"), schemas.RAW_ORDERS)
    table, _ = land_entity(store, ENTITIES[0], source)
    assert rows_of(store.open(table), "Order ID", "Sub-Category") == [("O-1", "Stools")]


def test_land_all_reports_every_sheet(spark, store):
    reports = {sheet: report for sheet, (_, report) in land_all(store, feed.sheets(spark, DATA)).items()}
    assert {s: r["columns"] for s, r in reports.items()} == {"Orders": 21, "People": 2, "Returns": 2}
    assert reports["Orders"]["rows"] == feed.raw_orders(spark, DATA).count()


# -- the store -------------------------------------------------------------------------------


def test_rows_of_an_order_lie_together_where_large_tables_meet(spark, no_broadcast):
    parts = feed.raw_orders(spark, DATA).select(F.spark_partition_id(), "Row ID").collect()
    orders = [(part, int(row) // 10) for part, row in parts]
    runs = sum(a != b for a, b in zip(orders, [None, *orders]))
    assert runs == len({order for _, order in orders})


def test_counts_are_taken_while_writing(spark, store):
    table = store.write("t", spark.range(10).withColumn("s", F.lit("abc")))
    assert (table.rows, table.bytes) == (10, 10 * (16 + 16 + 3))
    empty = store.write("t", spark.range(0))
    assert (empty.rows, empty.bytes) == (0, 0)
    filtered = store.write("t", spark.range(10).filter("id < 0").groupBy("id").count())
    assert filtered.rows == 0


def test_refresh_replaces_and_keeps_only_the_newest_versions(spark, store):
    for n in (1, 2, 3, 4):
        store.materialize("t", spark.range(n))
    assert store.read("t", spark.range(0).schema).count() == 4
    assert len(store._versions("t")) == 2


def test_failed_write_leaves_the_old_version_current(spark, store):
    store.materialize("t", spark.range(3))
    broken = spark.range(3).select((F.lit(1) / (F.col("id") - 1)).cast("int").alias("id"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.materialize("t", broken)
    assert store.read("t", spark.range(0).schema).count() == 3


def test_reading_what_was_never_written(store, spark):
    with pytest.raises(FileNotFoundError):
        store.read("nothing", spark.range(0).schema)


def test_catalog_follows_the_current_version(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "c"), database="shop_test")
    try:
        store.materialize("layer/t", spark.range(3))
        assert spark.table("shop_test.t").count() == 3
        store.materialize("layer/t", spark.range(5))
        assert spark.table("shop_test.t").count() == 5
        store.materialize("layer/t", spark.range(2).withColumn("more", F.lit("x")))
        assert spark.table("shop_test.t").columns == ["id", "more"]
        assert store.expire("layer/t") == 0
    finally:
        spark.sql("DROP DATABASE IF EXISTS shop_test CASCADE")


def test_parallel_jobs_raise_their_failure():
    assert in_parallel({"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2}
    with pytest.raises(ZeroDivisionError):
        in_parallel({"a": lambda: 1, "b": lambda: 1 // 0})


def test_scratch_folder_is_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark, "x")
    assert root.startswith(shared) if shared else root
    assert root != scratch_root(spark, "x")


# -- the whole run ---------------------------------------------------------------------------


def test_full_refresh_twice_gives_the_same_tables(spark, tmp_path):
    out = str(tmp_path / "out")
    first = run_pipeline(spark, feed.sheets(spark, DATA), out, database="shop_run")
    try:
        counts = {r["table"]: r["rows"] for r in first.report}
        assert len(counts) == 10 and all(counts.values())
        second = run_pipeline(spark, feed.sheets(spark, DATA), out, database="shop_run")
        assert {r["table"]: r["rows"] for r in second.report} == counts
        pairs = [(first.trusted, second.trusted), (first.fact, second.fact)]
        pairs += [(first.dims[n], second.dims[n]) for n in first.dims]
        for old, new in pairs:
            assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()
        store = TableStore(spark, out)
        for name, (path, schema) in REFINED.items():
            assert store.read(path, schema).count() == spark.table(f"shop_run.{name}").count()
        assert os.path.exists(os.path.join(out, "trusted", "trusted_orders"))
        assert "fact_orders" in second.publish_views()
        by_sql = spark.sql(
            "SELECT sum(f.quantity) FROM fact_orders f JOIN dim_customer USING (customer_key)"
        ).first()[0]
        assert by_sql == second.fact.agg(F.sum("quantity")).first()[0]
        assert second.checks(spark).filter("check = 'orphans' AND NOT passed").isEmpty()
    finally:
        spark.sql("DROP DATABASE IF EXISTS shop_run CASCADE")


def test_a_failing_trusted_layer_leaves_the_refined_tables(spark, tmp_path):
    out = str(tmp_path / "out")
    sheets = feed.sheets(spark, DATA)
    run_pipeline(spark, sheets, out)
    store = TableStore(spark, out)
    path, schema = REFINED["fact_orders"]
    before = store.read(path, schema).count()
    with pytest.raises(Exception):
        run_pipeline(spark, {**sheets, "Orders": sheets["Orders"].drop("Order ID")}, out)
    assert store.read(path, schema).count() == before


@pytest.mark.parametrize("stage", ["fact_orders", "dim_product"])
def test_a_run_that_fails_late_changes_no_table(spark, tmp_path, monkeypatch, stage):
    """The fact and the dimensions of the last good run still belong together."""
    out = str(tmp_path / "out")
    sheets = feed.sheets(spark, DATA)
    run_pipeline(spark, sheets, out)
    store = TableStore(spark, out)

    def sales_by_customer():
        fact, customers = (store.read(*REFINED[n]) for n in ("fact_orders", "dim_customer"))
        return rows_of(
            fact.join(customers, "customer_key").groupBy("customer_id").agg(F.sum("quantity"))
        )

    before = sales_by_customer()
    first = spark.createDataFrame([tuple({**ORDER, "Customer ID": "A-0"}.values())], schemas.RAW_ORDERS)

    def fails(*_, **__):
        raise RuntimeError("stopped")

    from silvermart.plans import star

    with monkeypatch.context() as broken:
        if stage == "fact_orders":
            broken.setattr(star, stage, fails)
        else:
            broken.setitem(star.DIMENSIONS, stage, fails)
        with pytest.raises(RuntimeError, match="stopped"):
            run_pipeline(spark, {**sheets, "Orders": first.unionByName(sheets["Orders"])}, out)
    assert sales_by_customer() == before
    # The next good run cleans up what the failed one has written.
    assert run_pipeline(spark, sheets, out).deleted >= 4
    assert sales_by_customer() == before


def test_unpublished_versions_are_never_read_and_go(spark, store):
    store.materialize("t", spark.range(3))
    store.write("t", spark.range(9))
    assert store.read("t", spark.range(0).schema).count() == 3
    assert store.publish(store.write("t", spark.range(4))) == 1
    assert store.read("t", spark.range(0).schema).count() == 4


@pytest.mark.parametrize(
    "fmt, lines",
    [
        ("csv", "Regional Manager,Region\nMia,East,surplus\n"),
        ("csv", 'Regional Manager,Region\n"Mia\nthe first",East\n'),
        ("json", '{"Regional Manager": "Mia", "Region": "East"}\n{"Regional Manager": "M\n'),
    ],
)
def test_malformed_records_end_the_landing(spark, store, tmp_path, fmt, lines):
    people = next(e for e in ENTITIES if e.sheet == "People")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"part.{fmt}").write_text(lines)
    with pytest.raises(Exception, match="(?i)malformed"):
        land_entity(store, people, read_source(spark, fmt, str(tmp_path / "in"), people.schema))


def test_line_breaks_in_cells_are_an_option(spark, store, tmp_path):
    people = next(e for e in ENTITIES if e.sheet == "People")
    (tmp_path / "in.csv").write_text('Regional Manager,Region\n"Mia\nthe first",East\n')
    source = read_source(spark, "csv", str(tmp_path / "in.csv"), people.schema, multi_line=True)
    assert rows_of(store.open(land_entity(store, people, source)[0])) == [("Mia\nthe first", "East")]


def test_doubles_land_without_exponents(spark):
    values = [12345678.0, 1e7, 123456789.25, -2.5e10, 0.0005, 1.5, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    assert [r.d for r in stringify(df).collect()] == [repr(v) for v in values]


def test_small_doubles_keep_their_digits(spark):
    values = [0.00012345678901234567, -0.00099, 0.0001, 0.0005, 0.001, 0.00012]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    assert [r.d for r in stringify(df).collect()] == [repr(v) for v in values]


@pytest.mark.parametrize(
    "fmt, lines, bad",
    [
        ("json", '{"Regional Manager":"Mia","Region":"East"}\n{"Regional\n', '{"Regional'),
        ("csv", "Regional Manager,Region\nMia,East\nMax,West,1,2\n", "Max,West,1,2"),
        ("csv", "Region,Regional Manager\nEast,Mia\n", None),
    ],
)
def test_malformed_records_go_to_the_rejects(spark, store, tmp_path, fmt, lines, bad):
    people = next(e for e in ENTITIES if e.sheet == "People")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"part.{fmt}").write_text(lines)
    source = read_with_rejects(spark, fmt, str(tmp_path / "in"), people.schema)
    scratch = TableStore(spark, str(tmp_path / "scratch"))
    table, rejects, report = land_with_rejects(store, scratch, people, source)
    assert rows_of(store.open(table)) == [("Mia", "East")]
    assert rows_of(store.open(rejects)) == ([(bad,)] if bad else [])
    assert (report["rows"], report["rejected"]) == (1, int(bad is not None))
