"""

A query on one layer reads the stored tables of the layers before it (see plans/workspace.py) and
computes its own result from them on every call.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle
from silvermart.functions import (
    normalize_region,
    parse_date,
    parse_money,
    parse_number,
    prefix_region,
    clean_text,
    trim_all,
)
from silvermart.operators.attach import with_row_tag
from silvermart.operators.distinct import distinct_by_digest
from silvermart.plans import checks, reports, star
from silvermart.plans import trusted as layer
from silvermart.plans.pipeline import run_pipeline
from silvermart.plans.workspace import Workspace, workspace
from silvermart.sources import feed
from silvermart.sources.landing import (
    ENTITIES,
    land_all,
    land_with_rejects,
    read_with_rejects,
    stringify,
)
from silvermart.sources.store import SMALL, TableStore, scratch_root

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """The ten products that lose the most, through all layers of the pipeline."""
    return queries()["bi_top10_loss"](spark, "/root/testdata/sf0.001")


def _on(build: Callable[[Workspace], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(workspace(spark, sf_dir))


def _land_sheets(w: Workspace) -> DataFrame:
    """Lands the three sheets anew and reports on it."""
    landed = land_all(w.scratch, feed.sheets(w.spark, w.sf_dir))
    return w.spark.createDataFrame(
        [(m["sheet"], m["rows"], m["columns"]) for _, m in landed.values()],
        "sheet string, rows long, columns int",
    )


def _full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline into a fresh folder, deleted afterwards; one row per table it wrote."""
    out = scratch_root(spark, "refresh")
    try:
        layers = run_pipeline(spark, feed.sheets(spark, sf_dir), out)
    finally:
        TableStore(spark, out).drop_all()
    return spark.createDataFrame(
        [(r["table"], r["rows"]) for r in layers.report], "table_name string, rows long"
    )


def _stringify_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of up to eleven digits as text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return stringify(
        orders.select(
            F.col("o_orderkey").alias("order_key"),
            (F.round(F.col("o_totalprice")) * 100000).alias("amount"),
            (F.round(F.col("o_totalprice")) * 100000 + 0.5).alias("half"),
        )
    )


def _stringify_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts below 0.001 as text, with all their digits."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = (F.col("o_orderkey") % 899 + 100).cast("double") / 1e6
    return stringify(orders.select(F.col("o_orderkey").alias("order_key"), part.alias("part")))


def _land_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON feed in which every tenth record breaks off: the landed rows and the rejected texts."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    people = next(e for e in ENTITIES if e.sheet == "People")
    whole = F.to_json(
        F.struct(
            F.col("c_name").alias("Regional Manager"),
            F.col("c_nationkey").cast("string").alias("Region"),
        )
    )
    broken = F.concat(F.lit('{"Regional Manager":"'), "c_name")
    root = scratch_root(spark, "rejects")
    TableStore(spark, root).drop_at_exit()
    line = F.when(F.col("c_custkey") % 10 == 0, broken).otherwise(whole)
    customers.select(line.alias("value")).write.text(f"{root}/feed")
    store, scratch = TableStore(spark, root), TableStore(spark, f"{root}/scratch")
    source = read_with_rejects(spark, "json", f"{root}/feed", people.schema)
    table, rejects, _ = land_with_rejects(store, scratch, people, source)
    scratch.drop_all()
    none = F.lit(None).cast("string")
    return (
        store.open(table)
        .select(F.col("Regional Manager").alias("manager"), F.col("Region").alias("region"))
        .withColumn("rejected", none)
        .unionByName(
            store.open(rejects).select(
                none.alias("manager"), none.alias("region"), F.col("record").alias("rejected")
            )
        )
    )


def _catalog_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with a database: every table read back by its name in the catalog."""
    database = f"silvermart_{uuid.uuid4().hex}"
    measures = {
        "trusted_orders": "quantity", "fact_orders": "quantity", "dim_date": "date_key",
        **{f"dim_{d}": f"{d}_key" for d in ("customer", "product", "geography", "shipping")},
    }
    out = scratch_root(spark, "catalog")
    try:
        run_pipeline(spark, feed.sheets(spark, sf_dir), out, database)
        rows = [
            (
                name,
                *spark.table(f"{database}.{name}").agg(F.count(F.lit(1)), F.sum(measure)).first(),
            )
            for name, measure in measures.items()
        ]
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
        TableStore(spark, out).drop_all()
    return spark.createDataFrame(rows, "table_name string, rows long, total long")


def _view_sales(w: Workspace) -> DataFrame:
    """Quantities by category and manager, in SQL over the temporary views of the star schema."""
    for name, df in {**w.dims, "fact_orders": w.fact}.items():
        df.createOrReplaceTempView(name)
    return w.spark.sql(
        """SELECT category, regional_manager, count(*) AS lines, sum(quantity) AS quantity
           FROM fact_orders JOIN dim_product USING (product_key)
           JOIN dim_geography USING (geography_key) GROUP BY category, regional_manager"""
    )


def _column(name: str):
    return trim_all(F.col(f"`{name}`"))


def _parse_dates(w: Workspace) -> DataFrame:
    trimmed = w.raw["Orders"].select(
        F.col("Row ID").alias("row_id"),
        _column("Order Date").alias("order_date"),
        _column("Ship Date").alias("ship_date"),
    )
    return trimmed.withColumns(
        {c: parse_date(F.col(c)) for c in ("order_date", "ship_date")}
    )


def _parse_money(w: Workspace) -> DataFrame:
    return w.raw["Orders"].select(
        F.col("Row ID").alias("row_id"),
        parse_money(_column("Sales")).alias("sales"),
        parse_money(_column("Profit")).alias("profit"),
        parse_number(_column("Quantity")).alias("quantity"),
        parse_number(_column("Discount")).alias("discount"),
    )


def _base(w: Workspace) -> DataFrame:
    return layer.clean_orders(w.raw["Orders"])


def _dedup_two_steps(w: Workspace) -> DataFrame:
    """The repaired rows, written first, each once; only the repeated ones are shuffled."""
    with w.scratch.section("repairs").dropped() as scratch:
        repaired = layer.repaired_orders(
            w.raw["Orders"], w.raw["Returns"], w.raw["People"], scratch
        )
        written = w.scratch.write("repaired_orders", repaired, compression=SMALL)
    return distinct_by_digest(written, w.scratch)


def _normalize_region(w: Workspace) -> DataFrame:
    spelled = w.raw["Orders"].groupBy(F.col("Region").alias("spelled")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return spelled.select(
        "spelled", normalize_region(clean_text(F.col("spelled"))).alias("region"), "rows"
    )


def _prefix_region(w: Workspace) -> DataFrame:
    pairs = _base(w).groupBy("country", normalize_region(F.col("region")).alias("region")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return pairs.select(
        "country", "region", prefix_region(F.col("country"), F.col("region")).alias("prefixed"),
        "rows",
    )


def _fill_ship_mode(w: Workspace) -> DataFrame:
    rows = with_row_tag(_base(w)).withColumn("before", F.col("ship_mode"))
    return layer.fill_by_key(rows, ["order_id"], ["ship_mode"], w.scratch).select(
        "order_id", "before", F.col("ship_mode").alias("after")
    )


def _fill_customer_name(w: Workspace) -> DataFrame:
    rows = with_row_tag(_base(w)).withColumn("before", F.col("customer_name"))
    return layer.fill_by_key(rows, ["customer_id"], ["customer_name"], w.scratch).select(
        "customer_id", "before", F.col("customer_name").alias("after")
    )


def _fill_postal_mode(w: Workspace) -> DataFrame:
    rows = with_row_tag(_base(w)).withColumn("before", F.col("postal_code"))
    return layer.fill_by_mode(rows, layer.LOCATION, "postal_code", w.scratch).select(
        *layer.LOCATION, "before", F.col("postal_code").alias("after")
    )


def _fill_category(w: Workspace) -> DataFrame:
    columns = ["category", "sub_category"]
    rows = with_row_tag(_base(w)).withColumns({f"{c}_before": F.col(c) for c in columns})
    return layer.fill_by_key(rows, ["product_id"], columns, w.scratch).select(
        "product_id", *[f"{c}_before" for c in columns], *columns
    )


def _canonical_product(w: Workspace) -> DataFrame:
    rows = with_row_tag(_base(w))
    return layer.canonicalize_by_mode(rows, ["product_id"], "product_name", w.scratch).select(
        "product_id", "product_name", "product_name_original"
    )


def _flag_returns(w: Workspace) -> DataFrame:
    rows = with_row_tag(_base(w)).withColumn("region", normalize_region(F.col("region")))
    return layer.flag_returns(
        rows,
        layer.clean_returns(w.raw["Returns"]),
        layer.clean_people(w.raw["People"]),
        w.scratch,
    ).select("order_id", "product_id", "is_returned", "regional_manager")


def _trusted(w: Workspace) -> DataFrame:
    return layer.trusted_orders(w.raw["Orders"], w.raw["Returns"], w.raw["People"], w.scratch)


def _listed(df: DataFrame, names: dict[str, str], joined: str) -> DataFrame:
    """Column names without blanks, and the list as one text, which any engine compares alike."""
    return df.select(
        [
            (F.array_join(c, " | ") if c == joined else F.col(f"`{c}`")).alias(names.get(c, c))
            for c in df.columns
        ]
    )


def _conflict(check: Callable[[DataFrame], DataFrame]) -> Query:
    names = {"Product ID": "product_id", "Customer ID": "customer_id"}
    return _on(lambda w: _listed(check(w.raw["Orders"]), names, "associated_names"))


def _fact(report: Callable[[DataFrame, DataFrame], DataFrame], dim: str) -> Query:
    return _on(lambda w: report(w.fact, w.dim(dim)))


def _dim(check: Callable[[DataFrame], DataFrame], dim: str) -> Query:
    return _on(lambda w: check(w.dim(dim)))


def _llm():
    """The text-preparation queries and the pipeline's, without them if their folders are absent."""
    try:
        from corpus_pipeline import ORACLE_SQL, run
        from silvermart.llm.queries import ORACLE_SQL as sql
        from silvermart.llm.queries import QUERIES
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "silvermart.llm"):
            raise
        return {}, {}
    return {**QUERIES, "pipeline": run}, {**sql, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}


def queries() -> dict[str, Query]:
    """Every registered query."""
    return {
        **_llm()[0],
        # landing
        "land_sheets": _on(_land_sheets),
        "raw_orders": feed.raw_orders,
        "raw_returns": feed.raw_returns,
        "raw_people": feed.raw_people,
        "stringify_customer": lambda spark, sf_dir: stringify(
            spark.read.parquet(f"{sf_dir}/customer.parquet")
        ),
        "stringify_amounts": _stringify_amounts,
        "stringify_small": _stringify_small,
        "land_rejects": _land_rejects,
        # cleaning
        "clean_orders": _on(_base),
        "clean_returns": _on(lambda w: layer.clean_returns(w.raw["Returns"])),
        "clean_people": _on(lambda w: layer.clean_people(w.raw["People"])),
        "parse_dates": _on(_parse_dates),
        "parse_money": _on(_parse_money),
        "normalize_region": _on(_normalize_region),
        "prefix_region": _on(_prefix_region),
        # repairs
        "fill_ship_mode": _on(_fill_ship_mode),
        "fill_customer_name": _on(_fill_customer_name),
        "fill_postal_mode": _on(_fill_postal_mode),
        "fill_category": _on(_fill_category),
        "canonical_product": _on(_canonical_product),
        "abs_discount": _on(
            lambda w: _base(w).select(
                "order_id", F.col("discount").alias("before"), F.abs("discount").alias("discount")
            )
        ),
        "flag_returns": _on(_flag_returns),
        "dedup_exact": _on(lambda w: _base(w).distinct()),
        "dedup_trusted": _on(
            lambda w: layer.dedup_exact(
                layer.repaired_orders(
                    w.raw["Orders"], w.raw["Returns"], w.raw["People"], w.scratch, tagged=True
                )
            )
        ),
        "dedup_two_steps": _on(_dedup_two_steps),
        "trusted_orders": _on(_trusted),
        "trusted_orders_shuffled": _on(
            lambda w: layer.trusted_orders(
                w.raw["Orders"], w.raw["Returns"], w.raw["People"], w.scratch, shuffled=True
            )
        ),
        "one_manager_per_region": _on(
            lambda w: layer.one_manager_per_region(layer.clean_people(w.raw["People"]))
        ),
        # star schema
        "dim_customer": _on(lambda w: star.dim_customer(w.trusted, w.scratch)),
        "dim_product": _on(lambda w: star.dim_product(w.trusted, w.scratch)),
        "dim_geography": _on(lambda w: star.dim_geography(w.trusted, w.scratch)),
        "dim_shipping": _on(lambda w: star.dim_shipping(w.trusted, w.scratch)),
        "dim_date": _on(lambda w: star.dim_date(w.trusted)),
        "fact_orders": _on(
            lambda w: star.fact_orders(
                w.trusted, w.dims, w.scratch, sizes=w.dim_sizes, counts=w.dim_counts
            )
        ),
        "fact_orders_shuffled": _on(
            lambda w: star.fact_orders(
                w.trusted,
                w.dims,
                w.scratch,
                shuffled=True,
                sizes=w.dim_sizes,
                counts=w.dim_counts,
            )
        ),
        # checks of the raw feed
        "check_category_conflict": _conflict(checks.category_conflict),
        "check_customer_conflict": _conflict(checks.customer_conflict),
        "check_product_conflict": _conflict(checks.product_conflict),
        "check_nan_profile": _on(lambda w: checks.nan_profile(w.raw["Orders"])),
        "check_returned_quantities": _on(
            lambda w: checks.returned_quantities(w.raw["Orders"], w.raw["Returns"])
        ),
        "check_returned_quantities_clean": _on(
            lambda w: checks.returned_quantities_clean(w.raw["Orders"], w.raw["Returns"])
        ),
        "check_valid_subcategory": _on(
            lambda w: _listed(
                checks.valid_subcategories(w.raw["Orders"]),
                {"Product ID": "product_id", "Category": "category"},
                "found_subcategories",
            )
        ),
        "check_category_conflict_rows": _on(
            lambda w: checks.category_conflict_rows(w.raw["Orders"])
        ),
        "check_customer_conflict_rows": _on(
            lambda w: checks.customer_conflict_rows(w.raw["Orders"])
        ),
        "check_product_conflict_rows": _on(
            lambda w: checks.product_conflict_rows(w.raw["Orders"])
        ),
        "check_valid_subcategory_rows": _on(
            lambda w: checks.valid_subcategory_rows(w.raw["Orders"])
        ),
        # checks of the star schema
        "check_fact_nulls": _on(lambda w: checks.fact_nulls(w.fact)),
        "check_orphan_customers": _fact(checks.orphan_customers, "dim_customer"),
        "check_orphan_geography": _fact(checks.orphan_geography, "dim_geography"),
        "check_orphan_products": _fact(checks.orphan_products, "dim_product"),
        "check_orphan_shipping": _fact(checks.orphan_shipping, "dim_shipping"),
        "check_orphan_dates": _fact(checks.orphan_dates, "dim_date"),
        "check_sales_faithful": _on(lambda w: checks.sales_faithful(w.trusted, w.fact)),
        "check_sales_by_order": _on(lambda w: checks.sales_by_order(w.trusted, w.fact)),
        "check_sales_total": _on(lambda w: checks.sales_total(w.trusted, w.fact)),
        "check_sales_total_whole": _on(lambda w: checks.sales_total_whole(w.trusted, w.fact)),
        "check_money_range": _on(lambda w: checks.money_range(w.trusted, w.fact)),
        "check_unique_customer_key": _dim(checks.unique_customer_key, "dim_customer"),
        "check_unique_product_key": _dim(checks.unique_product_key, "dim_product"),
        "check_unique_geography_key": _dim(checks.unique_geography_key, "dim_geography"),
        "check_unique_shipping_key": _dim(checks.unique_shipping_key, "dim_shipping"),
        "check_unique_date_key": _dim(checks.unique_date_key, "dim_date"),
        "check_natural_key_customer": _dim(checks.natural_key_customer, "dim_customer"),
        "check_natural_key_product": _dim(checks.natural_key_product, "dim_product"),
        "check_natural_key_geography": _dim(checks.natural_key_geography, "dim_geography"),
        "check_dropped_by_star_join": _on(lambda w: checks.dropped_by_star_join(w.trusted)),
        "check_volume": _on(lambda w: checks.volume({**w.dims, "fact_orders": w.fact})),
        "check_all": _on(
            lambda w: checks.run_checks(
                w.spark, w.raw["Orders"], w.raw["Returns"], w.trusted, w.dims, w.fact
            )
        ),
        "full_refresh": _full_refresh,
        "catalog_refresh": _catalog_refresh,
        "view_sales": _on(_view_sales),
        # reports
        "bi_margin_by_category": _fact(reports.margin_by_category, "dim_product"),
        "bi_top10_loss": _fact(reports.top_loss_products, "dim_product"),
        "bi_top10_loss_by_category": _fact(reports.top_loss_by_category, "dim_product"),
        "bi_monthly_sales": _fact(reports.monthly_sales, "dim_date"),
        "bi_half_year_sales": _fact(reports.half_year_sales, "dim_date"),
        "bi_return_rate": _fact(reports.return_rate, "dim_product"),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query above that SQL can express."""
    return {**_llm()[1], **oracle.queries()}
