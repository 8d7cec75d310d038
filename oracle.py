"""DuckDB SQL that states what each registered query must return.

Written independently of the Spark plans: whole-table SQL over the driver's views, put together
from common table expressions. `sql(final, *needs)` adds the expressions that a query needs.
"""

from __future__ import annotations

DATE_FORMATS = [
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m-%d-%Y", "%d/%m/%Y", "%d-%b-%Y", "%b %d %Y",
]


def text(column: str) -> str:
    return f"nullif(nullif(trim({column}), ''), 'nan')"


def upper_text(column: str) -> str:
    return f"nullif(nullif(upper(trim({column})), ''), 'NAN')"


def date(column: str) -> str:
    tries = ", ".join(f"try_strptime(trim({column}), '{f}')" for f in DATE_FORMATS)
    return f"CAST(coalesce({tries}) AS DATE)"


def number(column: str) -> str:
    return f"TRY_CAST(nullif(trim({column}), 'nan') AS DOUBLE)"


def money(column: str) -> str:
    return number(f"translate({column}, '$,', '')")


def region(column: str) -> str:
    return f"""CASE
      WHEN upper(trim({column})) IN ('CENTRAL REGION', 'CTR', 'CENTRAL') THEN 'Central'
      WHEN upper(trim({column})) IN ('EAST REGION', 'EAST') THEN 'East'
      WHEN upper(trim({column})) IN ('STH', 'SOUTH REGION', 'SOUTH') THEN 'South'
      WHEN upper(trim({column})) IN ('WST', 'WEST REGION', 'WEST') THEN 'West'
      ELSE trim({column}) END"""


def total(column: str) -> str:
    return f"sum(TRY_CAST({column} AS DECIMAL(30,8)))"


def as_money(expression: str) -> str:
    return f"CAST(round({expression}, 2) AS DOUBLE)"


def planted_date(column: str, turn: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN strftime(CAST({column} AS DATE), '{f}')" for i, f in enumerate(DATE_FORMATS)
    )
    return f"CASE {turn} {cases} ELSE 'NaT' END"


ALT = """CASE WHEN (p_partkey % 5 = 0 AND l_orderkey % 2 = 0)
            OR (p_partkey % 5 <> 0 AND l_orderkey % 9 = 0) THEN p_name || ' (alt)' ELSE p_name END"""

TRUSTED = [
    "order_id", "customer_id", "customer_name", "product_id", "order_date", "ship_date",
    "ship_mode", "segment", "country", "city", "state", "postal_code", "region", "category",
    "sub_category", "product_name", "product_name_original", "sales", "quantity", "discount",
    "profit", "is_returned", "regional_manager",
]

# name: (tables it reads, text)
CTES: dict[str, tuple[list[str], str]] = {
    "raw_orders": (
        [],
        f"""SELECT
      CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS "Row ID",
      CASE WHEN l_orderkey % 97 = 0 THEN 'nan' WHEN l_orderkey % 9 = 0 THEN 'ORD-' || l_orderkey
           ELSE ' ORD-' || l_orderkey END AS "Order ID",
      {planted_date("o_orderdate", "l_orderkey % 7")} AS "Order Date",
      {planted_date("l_shipdate", "(l_orderkey + l_linenumber) % 7")} AS "Ship Date",
      CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN l_linenumber % 4 = 1 THEN 'nan'
           WHEN o_orderpriority = '1-URGENT' THEN 'Same Day'
           WHEN o_orderpriority = '2-HIGH' THEN 'First Class'
           WHEN o_orderpriority = '3-MEDIUM' THEN 'Second Class'
           ELSE 'standard class ' END AS "Ship Mode",
      'C-' || c_custkey AS "Customer ID",
      CASE WHEN l_partkey % 11 = 0 THEN 'nan' WHEN l_orderkey % 43 = 0 THEN c_name || ' Jr'
           ELSE c_name END AS "Customer Name",
      CASE WHEN c_custkey % 61 = 0 THEN 'nan' WHEN l_orderkey % 47 = 0 THEN 'OTHER'
           ELSE c_mktsegment END AS "Segment",
      CASE WHEN n_regionkey <> 1 THEN n_name WHEN n_nationkey % 2 = 0 THEN 'United States'
           ELSE 'Canada' END AS "Country/Region",
      'City ' || (c_custkey % 40) AS "City",
      n_name AS "State/Province",
      CASE WHEN l_suppkey % 13 = 0 THEN 'nan' WHEN l_orderkey % 50 = 0 THEN '99999'
           ELSE CAST(10000 + c_custkey % 40 AS VARCHAR) END AS "Postal Code",
      CASE n_regionkey
        WHEN 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'Ctr' ELSE 'Central Region' END
        WHEN 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'East Region' ELSE 'East' END
        WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'Sth' ELSE 'south ' END
        WHEN 3 THEN 'WST' WHEN 4 THEN 'North' END AS "Region",
      'P-' || p_partkey AS "Product ID",
      CASE WHEN l_linenumber % 6 = 0 THEN 'nan' WHEN l_orderkey % 41 = 0 THEN p_type || ' X'
           ELSE p_type END AS "Category",
      CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE p_brand END AS "Sub-Category",
      {ALT} AS "Product Name",
      CASE WHEN l_orderkey % 3 = 0 THEN '$' || format('{{:,.2f}}', l_extendedprice)
           ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS "Sales",
      CAST(CAST(CASE WHEN l_orderkey % 101 = 0 THEN -l_quantity
           WHEN l_orderkey % 103 = 0 THEN l_quantity + 0.5 ELSE l_quantity END AS DECIMAL(6,1))
           AS VARCHAR) AS "Quantity",
      CAST(CAST(CASE WHEN l_linenumber % 5 = 0 THEN -l_discount ELSE l_discount END
           AS DECIMAL(5,2)) AS VARCHAR) AS "Discount",
      CASE WHEN l_partkey % 53 = 0 THEN 'nan'
           ELSE CAST(CAST(floor(l_extendedprice * (l_discount - l_tax)) AS BIGINT) AS VARCHAR)
           END AS "Profit"
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
    JOIN (VALUES (1), (2)) AS copies(copy) ON copy = 1 OR p_partkey % 10 = 7""",
    ),
    "raw_returns": (
        [],
        """SELECT CASE WHEN l_linenumber % 7 = 0 THEN 'No' WHEN l_linenumber % 2 = 0 THEN 'yes '
                ELSE 'Yes' END AS "Returned",
           'ORD-' || l_orderkey AS "Order ID"
    FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3 = 0""",
    ),
    "raw_people": (
        [],
        """SELECT 'Mgr ' || r_name AS "Regional Manager",
           CASE r_regionkey WHEN 0 THEN 'Ctr' WHEN 1 THEN 'EAST' WHEN 2 THEN 'South Region'
                WHEN 3 THEN 'wst' WHEN 4 THEN 'North' END AS "Region"
    FROM region UNION ALL VALUES ('Temporary Manager', 'West'), ('nan', 'East'),
      ('Second Manager', 'West')""",
    ),
    "base": (
        ["raw_orders"],
        f"""SELECT
      {text('"Order ID"')} AS order_id, {text('"Customer ID"')} AS customer_id,
      {text('"Product ID"')} AS product_id, {text('"Segment"')} AS segment,
      {text('"Country/Region"')} AS country, {text('"City"')} AS city,
      {text('"State/Province"')} AS state, {text('"Postal Code"')} AS postal_code,
      {text('"Region"')} AS region, {text('"Product Name"')} AS product_name,
      {text('"Customer Name"')} AS customer_name, {upper_text('"Ship Mode"')} AS ship_mode,
      {upper_text('"Category"')} AS category, {upper_text('"Sub-Category"')} AS sub_category,
      {date('"Order Date"')} AS order_date, {date('"Ship Date"')} AS ship_date,
      {money('"Sales"')} AS sales, {money('"Profit"')} AS profit,
      {number('"Quantity"')} AS quantity, {number('"Discount"')} AS discount
    FROM raw_orders WHERE {text('"Order ID"')} IS NOT NULL""",
    ),
    "returned": (
        ["raw_returns"],
        f"""SELECT DISTINCT {text('"Order ID"')} AS order_id FROM raw_returns
    WHERE upper(trim("Returned")) = 'YES' AND {text('"Order ID"')} IS NOT NULL""",
    ),
    "people": (
        ["raw_people"],
        f"""SELECT {text('"Regional Manager"')} AS regional_manager,
           {region('"Region"')} AS region FROM raw_people
    WHERE {text('"Region"')} IS NOT NULL AND {text('"Regional Manager"')} <> 'Temporary Manager'""",
    ),
    "order_fill": (
        ["base"],
        "SELECT order_id, max(ship_mode) AS ship_mode_max FROM base GROUP BY order_id",
    ),
    "customer_fill": (
        ["base"],
        """SELECT customer_id, max(customer_name) AS customer_name_max
    FROM base WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    ),
    "product_fill": (
        ["base"],
        """SELECT product_id, max(category) AS category_max, max(sub_category) AS sub_category_max
    FROM base WHERE product_id IS NOT NULL GROUP BY product_id""",
    ),
    "postal_mode": (
        ["base"],
        """SELECT country, state, city, postal_code AS postal_code_mode
    FROM base WHERE postal_code IS NOT NULL GROUP BY country, state, city, postal_code
    QUALIFY row_number() OVER (PARTITION BY country, state, city
                               ORDER BY count(*) DESC, postal_code) = 1""",
    ),
    "name_mode": (
        ["base"],
        """SELECT product_id, product_name AS product_name_mode
    FROM base WHERE product_name IS NOT NULL GROUP BY product_id, product_name
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, product_name) = 1""",
    ),
    "deduplicated": (
        [
            "base", "returned", "people", "order_fill", "customer_fill", "product_fill",
            "postal_mode", "name_mode",
        ],
        f"""SELECT DISTINCT
        b.order_id, b.customer_id, coalesce(b.customer_name, customer_name_max) AS customer_name,
        b.product_id, order_date, ship_date, coalesce(ship_mode, ship_mode_max) AS ship_mode,
        segment, b.country, b.city, b.state,
        coalesce(postal_code, postal_code_mode) AS postal_code,
        {region("b.region")} AS region, coalesce(category, category_max) AS category,
        coalesce(sub_category, sub_category_max) AS sub_category,
        coalesce(product_name_mode, product_name) AS product_name,
        product_name AS product_name_original, sales, quantity, abs(discount) AS discount, profit,
        CAST(r.order_id IS NOT NULL AS INTEGER) AS is_returned, regional_manager
      FROM base b
      LEFT JOIN order_fill USING (order_id)
      LEFT JOIN customer_fill USING (customer_id)
      LEFT JOIN product_fill USING (product_id)
      LEFT JOIN name_mode USING (product_id)
      LEFT JOIN postal_mode USING (country, state, city)
      LEFT JOIN returned r ON r.order_id = b.order_id
      LEFT JOIN people p ON p.region = {region("b.region")}""",
    ),
    "trusted": (
        ["deduplicated"],
        """SELECT * REPLACE (
        CAST(CASE WHEN quantity < 0 THEN -floor(-quantity + 0.5) ELSE floor(quantity + 0.5) END
             AS INTEGER) AS quantity,
        CASE country WHEN 'United States' THEN 'US-' || region
                     WHEN 'Canada' THEN 'CA-' || region ELSE region END AS region)
    FROM deduplicated""",
    ),
    "dim_customer": (
        ["trusted"],
        """SELECT CAST(row_number() OVER (ORDER BY customer_id NULLS LAST,
             customer_name NULLS LAST, segment NULLS LAST) AS INTEGER) AS customer_key, *
    FROM (SELECT DISTINCT customer_id, customer_name, segment FROM trusted
          WHERE customer_id IS NOT NULL)""",
    ),
    "dim_product": (
        ["trusted"],
        """SELECT CAST(row_number() OVER (ORDER BY product_id NULLS LAST,
             product_name NULLS LAST, category NULLS LAST, sub_category NULLS LAST)
             AS INTEGER) AS product_key, *
    FROM (SELECT DISTINCT product_id, product_name, category, sub_category FROM trusted
          WHERE product_id IS NOT NULL)""",
    ),
    "dim_geography": (
        ["trusted"],
        """SELECT CAST(row_number() OVER (ORDER BY country NULLS LAST, region NULLS LAST,
             state NULLS LAST, city NULLS LAST, postal_code NULLS LAST,
             regional_manager NULLS LAST) AS INTEGER) AS geography_key, *
    FROM (SELECT DISTINCT country, region, state, city, postal_code, regional_manager
          FROM trusted WHERE country IS NOT NULL)""",
    ),
    "dim_shipping": (
        ["trusted"],
        """SELECT CAST(row_number() OVER (ORDER BY ship_mode) AS INTEGER) AS shipping_key, *
    FROM (SELECT DISTINCT coalesce(ship_mode, 'N/A') AS ship_mode FROM trusted)""",
    ),
    "dim_date": (
        ["trusted"],
        """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date,
      CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week,
      dayname(d) AS day_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
      CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name,
      CAST(quarter(d) AS INTEGER) AS quarter,
      'Q' || quarter(d) || ' ' || year(d) AS quarter_label,
      CAST(year(d) AS INTEGER) AS year, strftime(d, '%Y-%m') AS year_month,
      isodow(d) IN (6, 7) AS is_weekend
    FROM (SELECT CAST(unnest(generate_series(least(min(order_date), min(ship_date)),
              greatest(max(order_date), max(ship_date)), INTERVAL 1 DAY)) AS DATE) AS d
          FROM trusted)""",
    ),
    "fact": (
        ["trusted", "dim_customer", "dim_product", "dim_geography", "dim_shipping"],
        """SELECT order_id, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS order_date_key,
      CAST(strftime(ship_date, '%Y%m%d') AS INTEGER) AS ship_date_key,
      customer_key, product_key, geography_key, shipping_key,
      sales, quantity, discount, profit, is_returned,
      CAST(ship_date - order_date AS BIGINT) AS delivery_days,
      round(sales * discount, 2) AS discount_amount
    FROM trusted t
    JOIN dim_customer USING (customer_id, customer_name, segment)
    JOIN dim_product USING (product_id, product_name, category, sub_category)
    JOIN dim_geography g USING (country, region, state, city)
    JOIN dim_shipping s ON s.ship_mode = coalesce(t.ship_mode, 'N/A')
    WHERE g.postal_code IS NOT DISTINCT FROM t.postal_code""",
    ),
    "product_sales": (
        ["fact", "dim_product"],
        f"""SELECT product_id, product_name, category, sub_category,
      {total("sales")} AS s, {total("profit")} AS p
    FROM fact JOIN dim_product USING (product_key) GROUP BY ALL""",
    ),
    "top_loss": (
        ["product_sales"],
        "SELECT * FROM product_sales WHERE p < 0 ORDER BY p, product_id LIMIT 10",
    ),
}


def sql(final: str, *needs: str) -> str:
    """The query with the expressions it needs, each after the ones it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for read in CTES[name][0]:
            add(read)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS MATERIALIZED (\n    {CTES[name][1]}\n)" for name in ordered]
    return f"WITH {', '.join(parts)}\n{final}" if parts else final


def conflicts(key: str, value: str, shown: str, key_name: str) -> tuple[str, ...]:
    return (
        f"""SELECT "{key}" AS "{key_name}", count(*) AS diff_name_count,
      string_agg(name, ' | ' ORDER BY name) AS associated_names
    FROM (SELECT DISTINCT "{key}", {shown} AS name FROM raw_orders
          WHERE lower(trim("{value}")) NOT IN ('', 'nan'))
    GROUP BY 1 HAVING count(*) > 1""",
        "raw_orders",
    )


def conflict_rows(key: str, value: str, shown: str, key_name: str) -> tuple[str, ...]:
    return (
        f"""SELECT * FROM (
      SELECT "{key}" AS "{key_name}", {shown} AS name, count(*) AS "rows" FROM raw_orders
      WHERE lower(trim("{value}")) NOT IN ('', 'nan') GROUP BY 1, 2)
    QUALIFY count(*) OVER (PARTITION BY "{key_name}") > 1""",
        "raw_orders",
    )


PROFILE = {
    "row_id": "Row ID", "order_id": "Order ID", "order_date": "Order Date",
    "ship_date": "Ship Date", "ship_mode": "Ship Mode", "customer_id": "Customer ID",
    "customer_name": "Customer Name", "segment": "Segment", "country": "Country/Region",
    "city": "City", "state": "State/Province", "postal_code": "Postal Code", "region": "Region",
    "product_id": "Product ID", "category": "Category", "sub_category": "Sub-Category",
    "product_name": "Product Name", "sales": "Sales", "quantity": "Quantity",
    "discount": "Discount", "profit": "Profit",
}


def repeated(table: str, *columns: str) -> tuple[str, ...]:
    names = ", ".join(columns)
    return (
        f"SELECT {names}, count(*) AS qtd FROM {table} GROUP BY {names} HAVING count(*) > 1",
        table,
    )


def orphans(table: str, fact_key: str, dim_key: str, name: str) -> tuple[str, ...]:
    return (
        f"""SELECT count(*) AS {name} FROM fact
    WHERE NOT EXISTS (SELECT 1 FROM {table} d WHERE d.{dim_key} = fact.{fact_key})""",
        "fact",
        table,
    )


SALES = f"""SELECT {as_money("t")} AS total_sales_trusted, {as_money("f")} AS total_sales_fact,
      {as_money("t - f")} AS difference"""

REQUIRED = [
    "customer_id", "customer_name", "segment", "product_id", "product_name", "category",
    "sub_category", "country", "region", "state", "city",
]


def parts() -> dict[str, tuple[str, ...]]:
    """Per query its final SELECT and the common table expressions it reads."""
    missing_any = " OR ".join(f"{c} IS NULL" for c in REQUIRED)
    missing = [("any", missing_any)] + [(c, f"{c} IS NULL") for c in REQUIRED]
    return {
        # landing
        "land_sheets": (
            """SELECT 'Orders' AS sheet, count(*) AS "rows", 21 AS "columns" FROM raw_orders
    UNION ALL SELECT 'People', count(*), 2 FROM raw_people
    UNION ALL SELECT 'Returns', count(*), 2 FROM raw_returns""",
            "raw_orders",
            "raw_people",
            "raw_returns",
        ),
        "raw_orders": ("SELECT * FROM raw_orders", "raw_orders"),
        "raw_returns": ("SELECT * FROM raw_returns", "raw_returns"),
        "raw_people": ("SELECT * FROM raw_people", "raw_people"),
        "stringify_amounts": (
            """SELECT CAST(o_orderkey AS VARCHAR) AS order_key,
      CAST(round(o_totalprice) * 100000 AS VARCHAR) AS amount,
      CAST(round(o_totalprice) * 100000 + 0.5 AS VARCHAR) AS half FROM orders""",
        ),
        "stringify_small": (
            """SELECT CAST(o_orderkey AS VARCHAR) AS order_key,
      rtrim('0.000' || CAST(o_orderkey % 899 + 100 AS VARCHAR), '0') AS part FROM orders""",
        ),
        "land_rejects": (
            """SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS manager,
      CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS region,
      CASE WHEN c_custkey % 10 = 0 THEN '{"Regional Manager":"' || c_name END AS rejected
      FROM customer""",
        ),
        "stringify_customer": (
            """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
      CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
      c_mktsegment FROM customer""",
        ),
        # cleaning
        "clean_orders": ("SELECT * FROM base", "base"),
        "clean_returns": ("SELECT * FROM returned", "returned"),
        "clean_people": ("SELECT * FROM people", "people"),
        "parse_dates": (
            f"""SELECT "Row ID" AS row_id, {date('"Order Date"')} AS order_date,
      {date('"Ship Date"')} AS ship_date FROM raw_orders""",
            "raw_orders",
        ),
        "parse_money": (
            f"""SELECT "Row ID" AS row_id, {money('"Sales"')} AS sales,
      {money('"Profit"')} AS profit, {number('"Quantity"')} AS quantity,
      {number('"Discount"')} AS discount FROM raw_orders""",
            "raw_orders",
        ),
        "normalize_region": (
            f"""SELECT "Region" AS spelled, {region(text('"Region"'))} AS region,
      count(*) AS "rows" FROM raw_orders GROUP BY 1, 2""",
            "raw_orders",
        ),
        "prefix_region": (
            f"""SELECT country, {region("region")} AS region,
      CASE country WHEN 'United States' THEN 'US-' || {region("region")}
                   WHEN 'Canada' THEN 'CA-' || {region("region")}
                   ELSE {region("region")} END AS prefixed, count(*) AS "rows"
    FROM base GROUP BY ALL""",
            "base",
        ),
        # repairs
        "fill_ship_mode": (
            """SELECT order_id, ship_mode AS before, coalesce(ship_mode, ship_mode_max) AS after
    FROM base LEFT JOIN order_fill USING (order_id)""",
            "order_fill",
        ),
        "fill_customer_name": (
            """SELECT customer_id, customer_name AS before,
      coalesce(customer_name, customer_name_max) AS after
    FROM base LEFT JOIN customer_fill USING (customer_id)""",
            "customer_fill",
        ),
        "fill_postal_mode": (
            """SELECT country, state, city, postal_code AS before,
      coalesce(postal_code, postal_code_mode) AS after
    FROM base LEFT JOIN postal_mode USING (country, state, city)""",
            "postal_mode",
        ),
        "fill_category": (
            """SELECT product_id, category AS category_before, sub_category AS sub_category_before,
      coalesce(category, category_max) AS category,
      coalesce(sub_category, sub_category_max) AS sub_category
    FROM base LEFT JOIN product_fill USING (product_id)""",
            "product_fill",
        ),
        "canonical_product": (
            """SELECT product_id, coalesce(product_name_mode, product_name) AS product_name,
      product_name AS product_name_original FROM base LEFT JOIN name_mode USING (product_id)""",
            "name_mode",
        ),
        "abs_discount": (
            "SELECT order_id, discount AS before, abs(discount) AS discount FROM base", "base"
        ),
        "flag_returns": (
            f"""SELECT b.order_id, b.product_id, CAST(r.order_id IS NOT NULL AS INTEGER) AS is_returned,
      regional_manager FROM base b LEFT JOIN returned r ON r.order_id = b.order_id
    LEFT JOIN people p ON p.region = {region("b.region")}""",
            "base",
            "returned",
            "people",
        ),
        "dedup_exact": ("SELECT DISTINCT * FROM base", "base"),
        "dedup_trusted": (f"SELECT {', '.join(TRUSTED)} FROM deduplicated", "deduplicated"),
        "dedup_two_steps": (f"SELECT {', '.join(TRUSTED)} FROM deduplicated", "deduplicated"),
        "trusted_orders": (f"SELECT {', '.join(TRUSTED)} FROM trusted", "trusted"),
        "trusted_orders_shuffled": (f"SELECT {', '.join(TRUSTED)} FROM trusted", "trusted"),
        "one_manager_per_region": (
            "SELECT region, min(regional_manager) AS regional_manager FROM people GROUP BY region",
            "people",
        ),
        # star schema
        "dim_customer": ("SELECT * FROM dim_customer", "dim_customer"),
        "dim_product": ("SELECT * FROM dim_product", "dim_product"),
        "dim_geography": ("SELECT * FROM dim_geography", "dim_geography"),
        "dim_shipping": ("SELECT * FROM dim_shipping", "dim_shipping"),
        "dim_date": ("SELECT * FROM dim_date", "dim_date"),
        "fact_orders": ("SELECT * FROM fact", "fact"),
        "fact_orders_shuffled": ("SELECT * FROM fact", "fact"),
        # checks of the raw feed
        "check_category_conflict": conflicts(
            "Product ID", "Category", 'trim(upper("Category"))', "product_id"
        ),
        "check_customer_conflict": conflicts(
            "Customer ID", "Customer Name", '"Customer Name"', "customer_id"
        ),
        "check_product_conflict": conflicts(
            "Product ID", "Product Name", '"Product Name"', "product_id"
        ),
        "check_category_conflict_rows": conflict_rows(
            "Product ID", "Category", 'upper(trim("Category"))', "product_id"
        ),
        "check_customer_conflict_rows": conflict_rows(
            "Customer ID", "Customer Name", '"Customer Name"', "customer_id"
        ),
        "check_product_conflict_rows": conflict_rows(
            "Product ID", "Product Name", '"Product Name"', "product_id"
        ),
        "check_valid_subcategory_rows": (
            """SELECT "Product ID" AS product_id, "Category" AS category,
      "Sub-Category" AS sub_category, count(*) AS "rows" FROM raw_orders o
    WHERE lower(trim("Sub-Category")) NOT IN ('', 'nan') AND EXISTS (
      SELECT 1 FROM raw_orders m WHERE m."Product ID" = o."Product ID"
        AND m."Category" = o."Category" AND lower(trim(m."Sub-Category")) IN ('', 'nan'))
    GROUP BY 1, 2, 3""",
            "raw_orders",
        ),
        "check_nan_profile": (
            " UNION ALL ".join(
                f"""SELECT '{name}' AS column_name, count(*) AS null_count FROM raw_orders
    WHERE lower(trim("{raw}")) = 'nan' HAVING count(*) > 0"""
                for name, raw in PROFILE.items()
            ),
            "raw_orders",
        ),
        "check_returned_quantities": (
            """SELECT DISTINCT "Quantity" AS quantity FROM raw_orders
    WHERE "Order ID" IN (SELECT "Order ID" FROM raw_returns)""",
            "raw_orders",
            "raw_returns",
        ),
        "check_returned_quantities_clean": (
            f"""SELECT DISTINCT "Quantity" AS quantity FROM raw_orders
    WHERE {text('"Order ID"')} IN (SELECT {text('"Order ID"')} FROM raw_returns)""",
            "raw_orders",
            "raw_returns",
        ),
        "check_valid_subcategory": (
            """SELECT "Product ID" AS product_id, "Category" AS category,
      string_agg(DISTINCT "Sub-Category", ' | ' ORDER BY "Sub-Category") AS found_subcategories,
      count(DISTINCT "Sub-Category") AS valid_options_count
    FROM raw_orders
    WHERE lower(trim("Sub-Category")) NOT IN ('', 'nan')
      AND ("Product ID", "Category") IN (SELECT ("Product ID", "Category") FROM raw_orders
            WHERE "Sub-Category" IS NULL OR lower(trim("Sub-Category")) IN ('', 'nan'))
    GROUP BY 1, 2""",
            "raw_orders",
        ),
        # checks of the star schema
        "check_fact_nulls": (
            """SELECT count(*) AS total_rows,
      CAST(count(*) FILTER (order_date_key IS NULL) AS BIGINT) AS null_order_dates,
      CAST(count(*) FILTER (ship_date_key IS NULL) AS BIGINT) AS null_ship_dates,
      CAST(count(*) FILTER (delivery_days < 0) AS BIGINT) AS negative_delivery_days,
      CAST(count(*) FILTER (discount_amount IS NULL) AS BIGINT) AS null_discounts FROM fact""",
            "fact",
        ),
        "check_orphan_customers": orphans(
            "dim_customer", "customer_key", "customer_key", "orphan_customers"
        ),
        "check_orphan_geography": orphans(
            "dim_geography", "geography_key", "geography_key", "orphan_geography"
        ),
        "check_orphan_products": orphans(
            "dim_product", "product_key", "product_key", "orphan_products"
        ),
        "check_orphan_shipping": orphans(
            "dim_shipping", "shipping_key", "shipping_key", "orphan_shipping"
        ),
        "check_orphan_dates": (
            """SELECT count(*) AS orphan_dates FROM (SELECT order_date_key AS k FROM fact
      UNION ALL SELECT ship_date_key FROM fact)
    WHERE k IS NOT NULL AND k NOT IN (SELECT date_key FROM dim_date)""",
            "fact",
            "dim_date",
        ),
        "check_sales_faithful": (
            f"""{SALES} FROM (SELECT {total("t.sales")} AS t, {total("f.sales")} AS f
      FROM trusted t FULL JOIN fact f ON t.order_id = f.order_id)""",
            "fact",
        ),
        "check_sales_by_order": (
            f"""SELECT order_id, coalesce(t_rows, 0) AS trusted_rows,
      coalesce(f_rows, 0) AS fact_rows, {as_money("coalesce(t, 0)")} AS total_sales_trusted,
      {as_money("coalesce(f, 0)")} AS total_sales_fact,
      {as_money("coalesce(t, 0) - coalesce(f, 0)")} AS difference
    FROM (SELECT order_id, count(*) AS t_rows, {total("sales")} AS t FROM trusted GROUP BY 1)
    FULL JOIN (SELECT order_id, count(*) AS f_rows, {total("sales")} AS f FROM fact GROUP BY 1)
      USING (order_id)
    WHERE coalesce(t_rows, 0) <> coalesce(f_rows, 0) OR coalesce(t, 0) <> coalesce(f, 0)""",
            "fact",
        ),
        "check_sales_total": (
            f"""{SALES} FROM (SELECT coalesce({total("sales")}, 0) AS t FROM trusted),
      (SELECT coalesce({total("sales")}, 0) AS f FROM fact)""",
            "fact",
        ),
        "check_sales_total_whole": (
            f"""{SALES} FROM (SELECT coalesce({total("sales")}, 0) AS t FROM trusted),
      (SELECT coalesce({total("sales")}, 0) AS f FROM fact)""",
            "fact",
        ),
        "check_money_range": (
            " UNION ALL ".join(
                f"""SELECT '{name}' AS table_name,
      count(*) FILTER (sales IS NOT NULL AND TRY_CAST(sales AS DECIMAL(30,8)) IS NULL) AS sales_beyond,
      count(*) FILTER (profit IS NOT NULL AND TRY_CAST(profit AS DECIMAL(30,8)) IS NULL)
        AS profit_beyond FROM {table} GROUP BY 1"""
                for name, table in (("trusted_orders", "trusted"), ("fact_orders", "fact"))
            ),
            "fact",
        ),
        "check_unique_customer_key": repeated("dim_customer", "customer_key"),
        "check_unique_product_key": repeated("dim_product", "product_key"),
        "check_unique_geography_key": repeated("dim_geography", "geography_key"),
        "check_unique_shipping_key": repeated("dim_shipping", "shipping_key"),
        "check_unique_date_key": repeated("dim_date", "date_key"),
        "check_natural_key_customer": repeated("dim_customer", "customer_id"),
        "check_natural_key_product": repeated("dim_product", "product_id"),
        "check_natural_key_geography": repeated(
            "dim_geography", "country", "region", "state", "city", "postal_code"
        ),
        "check_dropped_by_star_join": (
            " UNION ALL ".join(
                f"""SELECT '{name}' AS missing, count(*) AS "rows" FROM trusted WHERE {condition}
    HAVING count(*) > 0"""
                for name, condition in missing
            ),
            "trusted",
        ),
        "check_volume": (
            " UNION ALL ".join(
                f"SELECT '{name}' AS table_name, count(*) AS total_rows FROM {table}"
                for name, table in [
                    ("dim_date", "dim_date"),
                    ("dim_customer", "dim_customer"),
                    ("dim_product", "dim_product"),
                    ("dim_geography", "dim_geography"),
                    ("dim_shipping", "dim_shipping"),
                    ("fact_orders", "fact"),
                ]
            ),
            "fact",
            "dim_date",
        ),
        "full_refresh": (
            """SELECT 'raw_orders' AS table_name, count(*) AS "rows" FROM raw_orders
    UNION ALL SELECT 'raw_people', count(*) FROM raw_people
    UNION ALL SELECT 'raw_returns', count(*) FROM raw_returns
    UNION ALL SELECT 'trusted_orders', count(*) FROM trusted
    UNION ALL SELECT 'dim_customer', count(*) FROM dim_customer
    UNION ALL SELECT 'dim_product', count(*) FROM dim_product
    UNION ALL SELECT 'dim_geography', count(*) FROM dim_geography
    UNION ALL SELECT 'dim_shipping', count(*) FROM dim_shipping
    UNION ALL SELECT 'dim_date', count(*) FROM dim_date
    UNION ALL SELECT 'fact_orders', count(*) FROM fact""",
            "raw_people", "fact", "dim_date",
        ),
        "catalog_refresh": (
            " UNION ALL ".join(
                f"""SELECT '{name}' AS table_name, count(*) AS "rows",
      CAST(sum({measure}) AS BIGINT) AS total FROM {table}"""
                for name, table, measure in [
                    ("trusted_orders", "trusted", "quantity"),
                    ("fact_orders", "fact", "quantity"),
                    ("dim_date", "dim_date", "date_key"),
                    ("dim_customer", "dim_customer", "customer_key"),
                    ("dim_product", "dim_product", "product_key"),
                    ("dim_geography", "dim_geography", "geography_key"),
                    ("dim_shipping", "dim_shipping", "shipping_key"),
                ]
            ),
            "fact", "dim_date",
        ),
        "view_sales": (
            """SELECT category, regional_manager, count(*) AS lines,
      CAST(sum(quantity) AS BIGINT) AS quantity
    FROM fact JOIN dim_product USING (product_key) JOIN dim_geography USING (geography_key)
    GROUP BY category, regional_manager""",
            "fact", "dim_product", "dim_geography",
        ),
        # reports
        "bi_margin_by_category": (
            f"""SELECT category, {as_money("sum(s)")} AS sales, {as_money("sum(p)")} AS profit,
      CASE WHEN sum(s) <> 0 THEN CAST(sum(p) AS DOUBLE) / CAST(sum(s) AS DOUBLE) END AS profit_margin
    FROM product_sales GROUP BY category""",
            "product_sales",
        ),
        "bi_top10_loss": (
            f"""SELECT product_id, product_name, category, sub_category, {as_money("s")} AS sales,
      {as_money("p")} AS profit FROM top_loss""",
            "top_loss",
        ),
        "bi_top10_loss_by_category": (
            "SELECT category, count(*) AS products FROM top_loss GROUP BY category", "top_loss"
        ),
        "bi_monthly_sales": (
            f"""SELECT year_month, {as_money(total("sales"))} AS sales,
      {as_money(total("profit"))} AS profit, count(*) AS lines
    FROM fact LEFT JOIN dim_date ON date_key = order_date_key GROUP BY year_month""",
            "fact",
            "dim_date",
        ),
        "bi_half_year_sales": (
            f"""SELECT year, CASE WHEN month_number <= 6 THEN 'H1' WHEN month_number > 6 THEN 'H2' END
      AS half, {as_money(total("sales"))} AS sales, count(*) AS lines
    FROM fact LEFT JOIN dim_date ON date_key = order_date_key GROUP BY 1, 2""",
            "fact",
            "dim_date",
        ),
        "bi_return_rate": (
            f"""SELECT category, count(*) AS lines,
      CAST(sum(is_returned) AS BIGINT) AS returned_lines,
      CAST(sum(is_returned) AS DOUBLE) / count(*) AS return_rate,
      {as_money("coalesce(" + total("sales") + " FILTER (is_returned = 1), 0)")} AS returned_sales
    FROM fact JOIN dim_product USING (product_key) GROUP BY category""",
            "fact",
            "dim_product",
        ),
    }


# Checks of the summary table by kind: listings pass when empty, counters when zero.
LISTINGS = [
    "category_conflict", "customer_conflict", "product_conflict", "unique_customer_key",
    "unique_product_key", "unique_geography_key", "unique_shipping_key", "unique_date_key",
    "natural_key_customer", "natural_key_product", "natural_key_geography",
    "dropped_by_star_join", "sales_by_order",
]
INFORMATIVE = ["nan_profile", "valid_subcategory"]
ORPHANS = ["customers", "geography", "products", "shipping", "dates"]


def summary(known: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The table of all checks."""
    rows: list[str] = []
    needs: list[str] = []

    def add(query: str, check: str, metric: str, value: str, passed: str) -> None:
        final, *reads = known[f"check_{query}"]
        rows.append(
            f"""SELECT '{check}' AS "check", {metric} AS metric,
      CAST({value} AS DOUBLE) AS value, {passed} AS passed FROM ({final})"""
        )
        needs.extend(reads)

    for name in LISTINGS:
        add(name, name, "'rows'", "count(*)", "count(*) = 0")
    for name in INFORMATIVE:
        add(name, name, "'rows'", "count(*)", "NULL::BOOLEAN")
    add(
        "returned_quantities_clean", "negative_returned_quantities", "'rows'",
        "count(*) FILTER (TRY_CAST(quantity AS DOUBLE) < 0)",
        "count(*) FILTER (TRY_CAST(quantity AS DOUBLE) < 0) = 0",
    )
    beyond = "count(*) FILTER (sales_beyond > 0 OR profit_beyond > 0)"
    add("money_range", "money_range", "'rows'", beyond, f"{beyond} = 0")
    add("fact_nulls", "fact_nulls", "'total_rows'", "total_rows", "NULL::BOOLEAN")
    for c in ("null_order_dates", "null_ship_dates", "negative_delivery_days", "null_discounts"):
        add("fact_nulls", "fact_nulls", f"'{c}'", c, f"{c} = 0")
    for c in ORPHANS:
        add(f"orphan_{c}", "orphans", f"'orphan_{c}'", f"orphan_{c}", f"orphan_{c} = 0")
    for name in ("sales_faithful", "sales_total"):
        for c in ("total_sales_trusted", "total_sales_fact"):
            add(name, name, f"'{c}'", c, "NULL::BOOLEAN")
        add(name, name, "'difference'", "difference", "difference = 0")
    add("volume", "volume", "table_name", "total_rows", "NULL::BOOLEAN")
    return " UNION ALL ".join(rows), *dict.fromkeys(needs)


def queries() -> dict[str, str]:
    known = parts()
    known["check_all"] = summary(known)
    return {name: sql(*query) for name, query in known.items()}
