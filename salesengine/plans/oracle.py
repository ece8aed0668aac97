"""The registered queries as SQL, for the side-by-side check.

Each text is a chain of common table expressions over the raw test tables: the
star schema first, then the steps of one query, written plainly and without
the rearrangements the Spark plans use.
"""

from __future__ import annotations

from salesengine.functions.filters import Filters
from salesengine.operators.alerts import DEFAULT, AlertThresholds
from salesengine.operators.snapshot import LABELS, LabelRules
from salesengine.sources import results

STAR = """
lines AS (
    SELECT l_orderkey,
           CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS order_date_key,
           l_partkey + 1 AS product_key,
           o_custkey AS customer_key,
           'SO' || CAST(l_orderkey AS VARCHAR) AS sales_order_number,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
fact_internet AS (
    SELECT order_date_key, product_key, customer_key, sales_order_number, amount
    FROM lines WHERE l_orderkey % 5 <> 0
),
fact_reseller AS (
    SELECT order_date_key, product_key, sales_order_number, amount
    FROM lines WHERE l_orderkey % 5 = 0
),
dim_date AS (
    SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
           CAST(o_orderdate AS DATE) AS full_date,
           CAST(year(o_orderdate) AS INTEGER) AS year,
           CAST(month(o_orderdate) AS INTEGER) AS month
    FROM orders
),
dim_product AS (
    SELECT p_partkey + 1 AS product_key, p_name AS product_name,
           nullif(p_type, 'PROMO') AS product_line,
           split_part(p_name, ' ', 1) AS color,
           CAST(p_size AS VARCHAR) AS size,
           p_retailprice AS list_price, p_brand AS model_name
    FROM part -- products
),
dim_customer AS (
    SELECT c_custkey AS customer_key,
           c_nationkey * 10 + list_position(
               ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'],
               c_mktsegment) - 1 AS geography_key
    FROM customer
),
dim_geography AS (
    SELECT DISTINCT c_nationkey * 10 + list_position(
               ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'],
               c_mktsegment) - 1 AS geography_key,
           r_name AS country, n_name AS state_province, c_mktsegment AS city
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    -- places
)"""

SNAPSHOT = (
    STAR
    + """,
unified AS (
    SELECT 'Internet' AS sales_channel, order_date_key, product_key, customer_key,
           sales_order_number, CAST(amount AS DECIMAL(18,4)) AS sales_amount
    FROM fact_internet
    UNION ALL
    SELECT 'Reseller', order_date_key, product_key, NULL, sales_order_number,
           CAST(amount AS DECIMAL(18,4))
    FROM fact_reseller
),
wide AS (
    SELECT u.*, d.full_date, d.year, d.month, p.product_name, p.product_line, p.color, p.size,
           g.country, g.state_province, g.city
    FROM unified u
    LEFT JOIN dim_date d ON u.order_date_key = d.date_key
    LEFT JOIN (SELECT product_key, product_name,
                      coalesce(product_line, 'Unknown') AS product_line,
                      coalesce(color, 'Unknown') AS color,
                      coalesce(size, 'Unknown') AS size
               FROM dim_product) p ON u.product_key = p.product_key
    LEFT JOIN dim_customer c ON u.customer_key = c.customer_key
    LEFT JOIN dim_geography g ON c.geography_key = g.geography_key
)"""
)


def _cents(expression: str) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(28,2)) AS DOUBLE)"


def _quotient(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0))"


def _rounded(expression: str, scale: int) -> str:
    return (
        f"CAST(CAST(CAST({expression} AS DECIMAL(38,10)) AS DECIMAL(28,{scale})) AS DOUBLE)"
    )


def _month_label(year: str = "year", month: str = "month") -> str:
    return f"concat_ws('-', CAST({year} AS VARCHAR), lpad(CAST({month} AS VARCHAR), 2, '0'))"


def _limit(limit: int | None) -> str:
    return "" if limit is None else f" LIMIT {limit}"


def unmatched(sql: str) -> str:
    """The same query over dimensions with gaps."""
    gaps = {
        "-- products": "WHERE p_partkey % 97 <> 0",
        "-- places": "WHERE c_nationkey <> 24",
    }
    for mark, gap in gaps.items():
        sql = sql.replace(mark, gap)
    return sql


def _query(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


CUSTOMER_PLACES = _query(
    STAR,
    """SELECT customer_key, country, state_province, city
FROM dim_customer c LEFT JOIN dim_geography g ON c.geography_key = g.geography_key""",
)
UNIFIED_SALES = _query(
    SNAPSHOT,
    """SELECT sales_channel, order_date_key, product_key, customer_key, sales_order_number,
       CAST(sales_amount AS DOUBLE) AS sales_amount FROM unified""",
)
SALES_WIDE = _query(
    SNAPSHOT,
    """SELECT * REPLACE (CAST(sales_amount AS DOUBLE) AS sales_amount,
                  strftime(full_date, '%Y-%m-%d') AS full_date) FROM wide""",
)

SNAPSHOT_MODULES = (
    SNAPSHOT
    + f""",
kpi_totals AS (
    SELECT coalesce(sum(sales_amount), 0) AS total,
           count(DISTINCT sales_order_number) AS order_count,
           count(DISTINCT customer_key) AS customer_count,
           count(DISTINCT product_key) AS product_count
    FROM wide
),
kpis AS (
    SELECT CAST(total AS DOUBLE) AS total_sales, order_count, customer_count,
           product_count AS hot_product_count, product_count,
           coalesce({_rounded(_quotient('total', 'order_count'), 2)}, 0) AS avg_order_value
    FROM kpi_totals
),
monthly AS (
    SELECT year, month, sum(sales_amount) AS total,
           count(DISTINCT sales_order_number) AS order_count,
           lag(sum(sales_amount)) OVER (ORDER BY year NULLS FIRST, month NULLS FIRST) AS previous
    FROM wide GROUP BY year, month
),
growing AS (
    SELECT *, CASE WHEN previous > 0
                   THEN {_quotient('(total - previous)', 'previous')} ELSE 0 END AS growth
    FROM monthly
),
trend AS (
    SELECT year, month, {_cents('total')} AS sales_amount, order_count,
           {_month_label()} AS year_month,
           {_rounded('growth', 4)} AS mom_growth_rate,
           CASE WHEN growth > 0.02 THEN 'up' WHEN growth < -0.02 THEN 'down'
                ELSE 'stable' END AS trend_direction
    FROM growing
),
channel_totals AS (
    SELECT sales_channel, sum(sales_amount) AS total,
           count(DISTINCT sales_order_number) AS order_count
    FROM wide GROUP BY sales_channel
),
channel_shares AS (
    SELECT *, coalesce({_quotient('total', '(SELECT sum(total) FROM channel_totals)')}, 0) AS share,
           coalesce({_quotient('order_count', '(SELECT sum(order_count) FROM channel_totals)')}, 0)
               AS order_share
    FROM channel_totals
),
channels AS (
    SELECT sales_channel, {_cents('total')} AS sales_amount, order_count,
           {_rounded('share', 4)} AS sales_ratio, {_rounded('order_share', 4)} AS order_ratio,
           coalesce({_rounded(_quotient('total', 'order_count'), 2)}, 0) AS avg_order_amount,
           CASE WHEN share >= 0.5 THEN 'primary' ELSE 'supplementary' END AS performance_summary
    FROM channel_shares
),
product_totals AS (
    SELECT product_key, product_name, product_line, color, size, sum(sales_amount) AS total,
           count(DISTINCT sales_order_number) AS order_count
    FROM wide GROUP BY ALL
),
product_shares AS (
    SELECT *, coalesce({_quotient('total', '(SELECT sum(sales_amount) FROM wide)')}, 0) AS share
    FROM product_totals
),
all_products AS (
    SELECT product_key, product_name, product_line, color, size, total,
           {_cents('total')} AS sales_amount, order_count,
           {_rounded('share', 4)} AS contribution_rate,
           CASE WHEN share >= 0.08 THEN 'high_contribution' ELSE 'stable' END AS product_health
    FROM product_shares
),
top_products AS (
    SELECT * EXCLUDE (total) FROM all_products ORDER BY total DESC, product_key LIMIT 10
),
place_totals AS (
    SELECT country, state_province, city, sum(sales_amount) AS total,
           count(DISTINCT customer_key) AS customer_count,
           count(DISTINCT sales_order_number) AS order_count
    FROM wide WHERE country IS NOT NULL
    GROUP BY country, state_province, city
    ORDER BY total DESC, country, state_province, city LIMIT 100
),
geo AS (
    SELECT country, state_province, city, {_cents('total')} AS sales_amount, customer_count,
           order_count,
           CASE WHEN total >= (SELECT coalesce(nullif(max(total), 0), 1) FROM place_totals)
                              * CAST(0.65 AS DECIMAL(3,2))
                THEN 'high_value' ELSE 'potential' END AS region_level
    FROM place_totals
)"""
)


def snapshot(module: str) -> str:
    return _query(SNAPSHOT_MODULES, f"SELECT * FROM {module}")


GEO_SNAPSHOT_ALL = _query(SNAPSHOT_MODULES.replace("city LIMIT 100", "city"), "SELECT * FROM geo")


def top_products_snapshot(limit: int, labels: LabelRules = LABELS) -> str:
    return _query(
        SNAPSHOT_MODULES.replace("share >= 0.08", f"share >= {labels.high_contribution_share}"),
        f"""SELECT * EXCLUDE (total) FROM all_products
ORDER BY total DESC, product_key LIMIT {limit}""",
    )


def _literal(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _date_tests(f: Filters) -> list[str]:
    tests = []
    if f.start_date:
        tests.append(f"full_date >= DATE {_literal(f.start_date)}")
    if f.end_date:
        tests.append(f"full_date <= DATE {_literal(f.end_date)}")
    return tests


def _other_tests(f: Filters) -> list[str]:
    tests = []
    if f.product_line:
        tests.append(f"coalesce(product_line, 'Unknown') = {_literal(f.product_line)}")
    if f.channel:
        tests.append(f"sales_channel = {_literal(f.channel)}")
    if f.country:
        tests.append(f"country_region = {_literal(f.country)}")
    return tests


def _where(tests: list[str]) -> str:
    return "WHERE " + " AND ".join(tests) if tests else ""


UNIFIED_GEO = (
    STAR
    + """,
unified_geo AS (
    SELECT 'Internet' AS sales_channel, order_date_key, product_key, i.customer_key,
           sales_order_number, CAST(amount AS DECIMAL(18,2)) AS sales_amount,
           g.country AS country_region
    FROM fact_internet i
    LEFT JOIN dim_customer c ON i.customer_key = c.customer_key
    LEFT JOIN dim_geography g ON c.geography_key = g.geography_key
    UNION ALL
    SELECT 'Reseller', order_date_key, product_key, NULL, sales_order_number,
           CAST(amount AS DECIMAL(18,2)), NULL
    FROM fact_reseller
),
joined AS (
    SELECT u.*, d.full_date, d.year, d.month, p.product_name, p.product_line, p.color, p.size
    FROM unified_geo u
    JOIN dim_date d ON u.order_date_key = d.date_key
    JOIN dim_product p ON u.product_key = p.product_key
)"""
)
UNIFIED_COLUMNS = """sales_channel, order_date_key, product_key, customer_key, sales_order_number,
       CAST(sales_amount AS DOUBLE) AS sales_amount, country_region"""
UNIFIED_SALES_GEO = _query(UNIFIED_GEO, f"SELECT {UNIFIED_COLUMNS} FROM unified_geo")


def _filtered(f: Filters) -> str:
    return f"""{UNIFIED_GEO},
filtered AS (SELECT * FROM joined {_where(_date_tests(f) + _other_tests(f))}),
product_totals AS (
    SELECT product_key, sum(sales_amount) AS total FROM filtered GROUP BY product_key
),
hot AS (
    SELECT * FROM product_totals
    WHERE total * (SELECT count(*) FROM product_totals) >= (SELECT sum(total) FROM product_totals)
)"""


def filtered_sales(f: Filters) -> str:
    return _query(_filtered(f), f"SELECT {UNIFIED_COLUMNS} FROM filtered")


def product_sales(f: Filters) -> str:
    return _query(
        _filtered(f), f"SELECT product_key, {_cents('total')} AS sales_amount FROM product_totals"
    )


def hot_products(f: Filters) -> str:
    return _query(_filtered(f), f"SELECT product_key, {_cents('total')} AS sales_amount FROM hot")


def kpis_filtered(f: Filters) -> str:
    return _query(
        _filtered(f),
        f"""SELECT {_cents('coalesce(sum(sales_amount), 0)')} AS total_sales,
       count(DISTINCT sales_order_number) AS order_count,
       count(DISTINCT customer_key) AS customer_count,
       (SELECT count(*) FROM hot) AS hot_product_count
FROM filtered""",
    )


def _trailing(f: Filters, extra: str = "") -> str:
    tests = _other_tests(f) + ([extra] if extra else [])
    asked = f"DATE {_literal(f.end_date)}" if f.end_date else "CAST(NULL AS DATE)"
    return f"""{UNIFIED_GEO},
base AS (SELECT * FROM joined {_where(tests)}),
end_date AS (
    SELECT CASE WHEN {asked} IS NULL OR {asked} > max(full_date) THEN max(full_date)
                ELSE {asked} END AS d
    FROM base
),
trend AS (
    SELECT year, month, {_month_label()} AS year_month,
           {_cents('sum(sales_amount)')} AS sales_amount,
           count(DISTINCT sales_order_number) AS order_count
    FROM base
    WHERE full_date <= (SELECT d FROM end_date)
      AND full_date >= (SELECT date_trunc('month', d) - INTERVAL 11 MONTH FROM end_date)
    GROUP BY year, month
)"""


def trend_filtered(f: Filters) -> str:
    return _query(_trailing(f), "SELECT * FROM trend")


def product_monthly(product_key: int, f: Filters) -> str:
    return _query(_trailing(f, f"product_key = {product_key}"), "SELECT * FROM trend")


PEAK_VALLEY = """,
peak_valley AS (
    (SELECT 'peak' AS kind, *, 'No listed month sold more.' AS reason
     FROM trend ORDER BY sales_amount DESC, year, month LIMIT 1)
    UNION ALL
    (SELECT 'valley', *, 'No listed month sold less.'
     FROM trend ORDER BY sales_amount, year, month LIMIT 1)
)"""


def trend_peak_valley(f: Filters) -> str:
    return _query(_trailing(f) + PEAK_VALLEY, "SELECT * FROM peak_valley")


def _panel(f: Filters) -> str:
    asked = f"DATE {_literal(f.end_date)}" if f.end_date else "CAST(NULL AS DATE)"
    return f"""{UNIFIED_GEO},
base AS (SELECT * FROM joined {_where(_other_tests(f))}),
ends AS (
    SELECT product_key, CASE WHEN {asked} IS NULL OR {asked} > max(full_date) THEN max(full_date)
                             ELSE {asked} END AS d
    FROM base GROUP BY product_key
),
panel AS (
    SELECT b.product_key, year, month, {_month_label()} AS year_month,
           {_cents('sum(sales_amount)')} AS sales_amount,
           count(DISTINCT sales_order_number) AS order_count
    FROM base b JOIN ends e ON b.product_key = e.product_key
    WHERE full_date <= d AND full_date >= date_trunc('month', d) - INTERVAL 11 MONTH
    GROUP BY b.product_key, year, month
)"""


def product_monthly_panel(f: Filters) -> str:
    return _query(_panel(f), "SELECT * FROM panel")


def _ranking(f: Filters, limit: int) -> str:
    return f"""{_filtered(f)},
ranking AS (
    SELECT product_key, product_name, coalesce(product_line, 'Unknown') AS product_line,
           coalesce(color, 'Unknown') AS color, coalesce(size, 'Unknown') AS size,
           {_cents('sum(sales_amount)')} AS sales_amount,
           count(DISTINCT sales_order_number) AS order_count
    FROM filtered GROUP BY ALL
    ORDER BY sales_amount DESC, product_key LIMIT {limit}
)"""


def top_products_filtered(f: Filters, limit: int) -> str:
    return _query(_ranking(f, limit), "SELECT * FROM ranking")


def geo_filtered(f: Filters, limit: int | None = 100) -> str:
    tests = _date_tests(f)
    if f.product_line:
        tests.append(f"coalesce(product_line, 'Unknown') = {_literal(f.product_line)}")
    if f.country:
        tests.append(f"country = {_literal(f.country)}")
    if f.channel == "Reseller":
        tests.append("1 = 0")
    return _query(
        STAR,
        f"""SELECT country, state_province, city, {_cents('sum(amount)')} AS sales_amount,
       count(DISTINCT i.customer_key) AS customer_count,
       count(DISTINCT sales_order_number) AS order_count
FROM fact_internet i
JOIN dim_date d ON i.order_date_key = d.date_key
JOIN dim_product p ON i.product_key = p.product_key
JOIN dim_customer c ON i.customer_key = c.customer_key
JOIN dim_geography g ON c.geography_key = g.geography_key
{_where(tests)}
GROUP BY country, state_province, city
ORDER BY sales_amount DESC, country, state_province, city{_limit(limit)}""",
    )


def _channels(f: Filters) -> str:
    return f"""{_filtered(f)},
channel_totals AS (
    SELECT sales_channel, sum(sales_amount) AS total,
           count(DISTINCT sales_order_number) AS order_count
    FROM filtered GROUP BY sales_channel
),
channels AS (
    SELECT sales_channel, {_cents('total')} AS sales_amount, order_count,
           {_rounded(_quotient('total', '(SELECT sum(total) FROM channel_totals)'), 4)}
               AS sales_ratio,
           {_rounded(_quotient('order_count', '(SELECT sum(order_count) FROM channel_totals)'), 4)}
               AS order_ratio,
           {_rounded(_quotient('total', 'order_count'), 2)} AS avg_order_amount
    FROM channel_totals
)"""


def channels_filtered(f: Filters) -> str:
    return _query(_channels(f), "SELECT * FROM channels")


OPTIONS = (
    STAR
    + """,
options AS (
    SELECT 'product_line' AS option_type, coalesce(product_line, 'Unknown') AS option_value
    FROM dim_product GROUP BY ALL
    UNION ALL
    SELECT 'country', country FROM dim_geography WHERE country IS NOT NULL GROUP BY ALL
    UNION ALL
    SELECT 'year', CAST(year AS VARCHAR) FROM dim_date GROUP BY ALL
)"""
)
FILTER_OPTIONS = _query(OPTIONS, "SELECT * FROM options")

FILTER_OPTIONS_GROUPED = _query(
    OPTIONS,
    """SELECT option_type, list_sort(list(option_value)) AS option_values
FROM options GROUP BY option_type
UNION ALL SELECT 'channel', ['Internet', 'Reseller']""",
)
# The same lists as one text each.
FILTER_OPTIONS_JOINED = f"""SELECT option_type, array_to_string(option_values, '|') AS option_values
FROM ({FILTER_OPTIONS_GROUPED})"""

SOURCE_ROW_COUNTS = _query(
    STAR,
    """SELECT (SELECT count(*) FROM fact_internet) AS internet_sales_rows,
       (SELECT count(*) FROM fact_reseller) AS reseller_sales_rows""",
)

ALERT_COLUMNS = "rule_order, level, type, title, description, metric_value, metric_reference"

ALERT_TEXTS = {
    "sales_drop": "year_month || ' reached less than {sales_drop} of the sales of ' || month_before || '.'",
    "top_product_dependency": "'Product ' || product_key || ' makes {top_product_share} or more of all sales.'",
    "channel_imbalance": "sales_channel || ' makes {channel_share} or more of all sales.'",
}


def _alerts(limits: AlertThresholds) -> str:
    texts = {kind: text.format(**vars(limits)) for kind, text in ALERT_TEXTS.items()}
    return (
        SNAPSHOT_MODULES
        + f""",
ordered AS (
    SELECT *, lag(sales_amount) OVER (ORDER BY year NULLS FIRST, month NULLS FIRST) AS before,
           lag(year_month) OVER (ORDER BY year NULLS FIRST, month NULLS FIRST) AS month_before,
           row_number() OVER (ORDER BY year DESC NULLS LAST, month DESC NULLS LAST) AS age
    FROM trend
),
fired AS (
    SELECT 1 AS rule_order, 'high' AS level, 'sales_drop' AS type,
           'Latest month below its bound' AS title, {texts['sales_drop']} AS description,
           sales_amount AS metric_value, before AS metric_reference,
           year_month AS subject, sales_amount AS amount
    FROM ordered
    WHERE age = 1 AND CAST(sales_amount AS DECIMAL(28,2))
                      < CAST(before AS DECIMAL(28,2)) * CAST({limits.sales_drop} AS DECIMAL(5,2))
    UNION ALL
    (SELECT 2, 'medium', 'top_product_dependency', 'One product above its share',
            {texts['top_product_dependency']}, contribution_rate, {limits.top_product_share},
            CAST(product_key AS VARCHAR), sales_amount
     FROM (SELECT * FROM top_products ORDER BY sales_amount DESC, product_key LIMIT 1)
     WHERE contribution_rate >= {limits.top_product_share})
    UNION ALL
    (SELECT 3, 'medium', 'channel_imbalance', 'One channel above its share',
            {texts['channel_imbalance']}, sales_ratio, {limits.channel_share},
            sales_channel, sales_amount
     FROM (SELECT * FROM channels ORDER BY sales_ratio DESC, sales_amount DESC, sales_channel LIMIT 1)
     WHERE sales_ratio >= {limits.channel_share})
    UNION ALL
    (SELECT 4, 'info', 'high_value_region', 'Place with most sales',
            country || ' is first by sales of all places listed.', sales_amount, NULL,
            country, sales_amount
     FROM (SELECT * FROM geo ORDER BY sales_amount DESC, country, state_province, city LIMIT 1)
     WHERE CAST(sales_amount AS DECIMAL(28,2)) >= CAST({limits.region_sales} AS DECIMAL(28,2)))
),
alerts AS (
    SELECT * FROM fired
    UNION ALL
    SELECT 5, 'info', 'stable_operation', 'No rule fired', 'All figures are within their bounds.',
           total_sales, NULL, NULL, total_sales
    FROM kpis WHERE NOT EXISTS (SELECT 1 FROM fired)
)"""
    )


def alerts_snapshot(limits: AlertThresholds = DEFAULT) -> str:
    return _query(_alerts(limits), f"SELECT {ALERT_COLUMNS} FROM alerts")


ALERTS_SNAPSHOT = alerts_snapshot()
# What the JSON column names and how much it sold.
ALERTS_SNAPSHOT_METRIC = _query(_alerts(DEFAULT), "SELECT rule_order, type, subject, amount FROM alerts")

CATALOG = """,
catalog AS (
    SELECT product_key, 'Renamed ' || product_key AS product_name, 'X' AS product_line,
           CAST(NULL AS VARCHAR) AS color, 'S' AS size, list_price, model_name,
           CAST(0 AS DOUBLE) AS sales_amount, CAST(0 AS BIGINT) AS order_count
    FROM dim_product WHERE coalesce(product_line, '') <> 'STANDARD' AND size <> '13'
),
tombstones AS (SELECT product_key FROM dim_product WHERE size = '13')"""

CHANGES = """,
listed AS (
    SELECT * FROM dim_product WHERE coalesce(product_line, '') <> 'STANDARD' AND size <> '13'
),
change_rows AS (
    SELECT product_key, 1 AS step, 'update' AS op, 'First' AS word, list_price, model_name
    FROM listed WHERE color = 'blue'
    UNION ALL SELECT product_key, 2, 'update', 'Second', list_price, model_name
    FROM listed WHERE model_name = 'Brand#2'
    UNION ALL SELECT product_key, 3, 'update', 'Doomed', list_price, model_name
    FROM listed WHERE color = 'red'
    UNION ALL SELECT product_key, 4, 'insert', 'New', list_price, model_name
    FROM dim_product WHERE model_name = 'Brand#6'
    UNION ALL SELECT product_key, 5, 'delete', '', list_price, model_name
    FROM listed WHERE color = 'red'
    UNION ALL SELECT product_key, 6, 'update', 'Too late', list_price, model_name
    FROM listed WHERE color = 'red'
    UNION ALL SELECT product_key, 7, 'delete', '', list_price, model_name
    FROM listed WHERE color = 'red' AND model_name = 'Brand#2'
    UNION ALL SELECT product_key, 1, 'update', 'Not listed', list_price, model_name
    FROM dim_product WHERE product_line = 'STANDARD' AND model_name = 'Brand#3'
    UNION ALL SELECT product_key, 5, 'delete', '', list_price, model_name
    FROM dim_product WHERE product_line = 'STANDARD' AND model_name = 'Brand#4'
),
largest AS (
    SELECT max(product_key) AS k
    FROM (SELECT product_key FROM catalog UNION ALL SELECT product_key FROM tombstones)
),
changes AS (
    SELECT product_key * 10 + step AS seq, op,
           CASE WHEN op <> 'insert' THEN product_key END AS product_key,
           CASE WHEN op <> 'delete' THEN word || ' ' || product_key END AS product_name,
           CAST(NULL AS VARCHAR) AS product_line,
           CASE WHEN op <> 'delete' THEN 'teal' END AS color,
           CAST(NULL AS VARCHAR) AS size,
           CASE WHEN op <> 'delete' THEN list_price + 1 END AS list_price,
           CASE WHEN op <> 'delete' THEN model_name END AS model_name
    FROM change_rows
    UNION ALL
    SELECT seq, 'update', k + 1, 'First new', 'Y', NULL, 'L', 9.5, NULL
    FROM largest, (SELECT 0 AS seq UNION ALL SELECT max(product_key) * 10 + 10 FROM dim_product)
),
new_products AS (
    SELECT (SELECT k FROM largest) + row_number() OVER (ORDER BY seq) AS product_key,
           product_name, product_line, color, size, list_price, model_name,
           CAST(0 AS DOUBLE) AS sales_amount, CAST(0 AS BIGINT) AS order_count, seq AS born
    FROM changes WHERE op = 'insert'
)"""

# What is left of a batch after some kinds of change are taken from it.
APPLIED = """,
lives AS (
    SELECT *, CAST(-1 AS BIGINT) AS born FROM catalog
    UNION ALL SELECT * FROM new_products WHERE '{insert}' = 'insert'
),
touching AS (
    SELECT c.*, l.product_key IS NOT NULL AND c.seq > l.born
                AND NOT EXISTS (
                    SELECT 1 FROM changes d
                    WHERE d.op = 'delete' AND d.product_key = c.product_key
                      AND d.seq < c.seq AND d.seq > l.born AND '{delete}' = 'delete'
                ) AS matched
    FROM changes c LEFT JOIN lives l ON c.product_key = l.product_key
    WHERE c.op IN ('{update}', '{delete}')
),
dead AS (SELECT DISTINCT product_key FROM touching WHERE op = 'delete' AND matched),
final_updates AS (
    SELECT * FROM touching WHERE op = 'update' AND matched
    QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY seq DESC) = 1
),
catalog_after AS (
    SELECT l.product_key,
           CASE WHEN u.seq IS NULL THEN l.product_name ELSE u.product_name END AS product_name,
           CASE WHEN u.seq IS NULL THEN l.product_line ELSE u.product_line END AS product_line,
           CASE WHEN u.seq IS NULL THEN l.color ELSE u.color END AS color,
           CASE WHEN u.seq IS NULL THEN l.size ELSE u.size END AS size,
           CASE WHEN u.seq IS NULL THEN l.list_price ELSE u.list_price END AS list_price,
           CASE WHEN u.seq IS NULL THEN l.model_name ELSE u.model_name END AS model_name,
           l.sales_amount, l.order_count
    FROM lives l LEFT JOIN final_updates u ON l.product_key = u.product_key
    WHERE l.product_key NOT IN (SELECT product_key FROM dead)
),
tombstones_after AS (
    SELECT product_key FROM tombstones UNION SELECT product_key FROM dead
)"""


def _applied(*ops: str) -> str:
    kept = {op: op if op in ops else "" for op in ("insert", "update", "delete")}
    return STAR + CATALOG + CHANGES + APPLIED.format(**kept)


CATALOG_SEED = _query(
    STAR,
    """SELECT DISTINCT product_key, product_name, coalesce(product_line, 'Unknown') AS product_line,
       coalesce(color, 'Unknown') AS color, coalesce(size, 'Unknown') AS size,
       coalesce(list_price, 0) AS list_price, coalesce(model_name, 'Unknown') AS model_name,
       CAST(0 AS DOUBLE) AS sales_amount, CAST(0 AS BIGINT) AS order_count
FROM dim_product WHERE product_name IS NOT NULL ORDER BY product_key DESC LIMIT 30""",
)
CATALOG_SEED_ALL = CATALOG_SEED.replace(" ORDER BY product_key DESC LIMIT 30", "")


def catalog_search(pattern: str, product_line: str | None) -> str:
    tests = [f"product_name ILIKE {_literal('%' + pattern + '%')}"]
    if product_line:
        tests.append(f"product_line = {_literal(product_line)}")
    return _query(STAR + CATALOG, f"SELECT * FROM catalog {_where(tests)}")


def catalog_lookup(product_key: int) -> str:
    return _query(STAR + CATALOG, f"SELECT * FROM catalog WHERE product_key = {product_key}")


CATALOG_LOOKUP_MANY = _query(
    STAR + CATALOG,
    "SELECT * FROM catalog WHERE product_key IN (SELECT product_key FROM fact_reseller)",
)
CATALOG_TOMBSTONES = _query(STAR + CATALOG, "SELECT product_key FROM tombstones")
CATALOG_INSERT = _query(
    STAR + CATALOG + CHANGES,
    "SELECT * FROM catalog UNION ALL SELECT * EXCLUDE (born) FROM new_products",
)
CATALOG_UPDATE = _query(_applied("update"), "SELECT * FROM catalog_after")
CATALOG_DELETE = _query(_applied("delete"), "SELECT * FROM catalog_after")
CATALOG_DELETE_TOMBSTONES = _query(_applied("delete"), "SELECT * FROM tombstones_after")
CATALOG_APPLY_CHANGES = _query(
    _applied("insert", "update", "delete"), "SELECT * FROM catalog_after"
)
CATALOG_APPLY_TOMBSTONES = _query(
    _applied("insert", "update", "delete"), "SELECT * FROM tombstones_after"
)
CATALOG_TWO_BATCHES = _query(
    _applied("insert", "update"),
    """SELECT * FROM catalog_after WHERE product_key NOT IN (
    SELECT product_key FROM changes WHERE op = 'delete'
)""",
)
CATALOG_CHANGE_REPORT = _query(
    _applied("insert", "update", "delete"),
    """SELECT seq, op, product_key, matched FROM touching
UNION ALL SELECT born, 'insert', product_key, true FROM new_products""",
)


def _overlaid(f: Filters, limit: int) -> str:
    shown = ",\n           ".join(
        f"CASE WHEN c.product_key IS NULL THEN r.{name} ELSE c.{name} END AS {name}"
        for name in ("product_name", "product_line", "color", "size")
    )
    return f"""{_ranking(f, limit)}{CATALOG},
overlaid AS (
    SELECT r.product_key, {shown}, r.sales_amount, r.order_count
    FROM ranking r LEFT JOIN catalog c ON r.product_key = c.product_key
    WHERE r.product_key NOT IN (SELECT product_key FROM tombstones)
)"""


def catalog_overlay(f: Filters, limit: int) -> str:
    return _query(_overlaid(f, limit), "SELECT * FROM overlaid")


def _other_ctes(text: str, base: str) -> str:
    """The tables a chain adds to a base it shares with another chain."""
    return text[len(base) :]


def alerts_filtered(f: Filters) -> str:
    trend = _other_ctes(_trailing(f), UNIFIED_GEO)
    return _query(
        f"""{_overlaid(f, 10)}{trend}{PEAK_VALLEY},
peak AS (SELECT * FROM peak_valley WHERE kind = 'peak'),
valley AS (SELECT * FROM peak_valley WHERE kind = 'valley'),
watched AS (
    SELECT *, row_number() OVER (ORDER BY sales_amount DESC, product_key) AS place FROM overlaid
),
alerts AS (
    SELECT 1 AS rule_order, 'high' AS level, 'monthly_volatility' AS type,
           'Months far apart' AS title,
           v.year_month || ' reached less than 0.65 of the sales of ' || p.year_month || '.'
               AS description,
           v.sales_amount AS metric_value, p.sales_amount AS metric_reference
    FROM peak p, valley v
    WHERE p.sales_amount <> 0 AND CAST(v.sales_amount AS DECIMAL(28,2))
          < CAST(p.sales_amount AS DECIMAL(28,2)) * CAST(0.65 AS DECIMAL(3,2))
    UNION ALL
    SELECT CAST(place + 1 AS INTEGER), 'medium', 'top_product_watch', 'Leading product',
           product_name || ' is number ' || place || ' by sales.',
           sales_amount, CAST(order_count AS DOUBLE)
    FROM watched WHERE place <= 2
)""",
        f"SELECT {ALERT_COLUMNS} FROM alerts",
    )


def _growth_pct(source: str) -> str:
    growth = _quotient(
        "(CAST(sales_amount AS DECIMAL(28,2)) - base) * 100", "base"
    )
    return f"""SELECT year, month, year_month AS month_label, sales_amount,
       CASE WHEN base IS NULL THEN 0 ELSE {_rounded(growth, 1)} END AS growth_pct
FROM (SELECT *, CASE WHEN before = 0 THEN 1 ELSE before END AS base
      FROM (SELECT *, lag(CAST(sales_amount AS DECIMAL(28,2)))
                      OVER (ORDER BY year NULLS FIRST, month NULLS FIRST) AS before
            FROM {source}))"""


MOM_GROWTH_PCT = _query(SNAPSHOT_MODULES, _growth_pct("trend"))


def mom_growth_pct(f: Filters) -> str:
    return _query(_trailing(f), _growth_pct("trend"))


def channel_tiles(f: Filters) -> str:
    figures = ",\n       ".join(
        f"coalesce(max(CASE WHEN sales_channel = '{channel}' THEN {figure} END), 0)"
        f" AS {channel.lower()}_{figure}"
        for channel in ("Internet", "Reseller")
        for figure in ("sales_amount", "order_count", "sales_ratio", "order_ratio")
    )
    return _query(_channels(f), f"SELECT {figures} FROM channels")


GEO_RANK = _query(
    SNAPSHOT_MODULES
    + """,
first_places AS (
    SELECT *, CAST(row_number() OVER (ORDER BY sales_amount DESC, country, state_province, city)
                   AS INTEGER) AS place
    FROM geo ORDER BY place LIMIT 8
)""",
    f"""SELECT place, country AS name, sales_amount,
       greatest(8, {_rounded(_quotient('CAST(sales_amount AS DECIMAL(28,2)) * 100',
                                       '(SELECT max(sales_amount) FROM first_places)'), 4)})
           AS bar_width
FROM first_places""",
)


def sparkline(f: Filters) -> str:
    def digit(value: str) -> str:
        return f"CAST(CAST(CAST({value} AS DECIMAL(38,10)) AS DECIMAL(9,1)) AS VARCHAR)"

    x = digit("CAST(i - 1 AS DOUBLE) / greatest(len(amounts) - 1, 1) * 72")
    y = digit(
        "22 - (amounts[i] - least(list_min(amounts), 0))"
        " / (greatest(list_max(amounts), 1) - least(list_min(amounts), 0)) * 20"
    )
    return _query(
        _panel(f),
        f"""SELECT product_key, year, month, year_month AS month_label, sales_amount,
       array_to_string(list_transform(range(1, len(amounts) + 1),
                                      lambda i: {x} || ',' || {y}), ' ') AS points
FROM (SELECT *, list(sales_amount) OVER (PARTITION BY product_key ORDER BY year, month
                                         ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS amounts
      FROM panel)""",
    )


def product_month_pivot(f: Filters, product_key: int | None, limit: int = 8) -> str:
    """Monthly sums are those up to the asked end date, of the listed products."""
    lead = f"product_key = {product_key}" if product_key else "1 = 0"
    ended = f"WHERE full_date <= DATE {_literal(f.end_date)}" if f.end_date else ""
    months = ",\n       ".join(
        f"coalesce((SELECT m.sales FROM months_sold m JOIN months c ON m.year = c.year"
        f" AND m.month = c.month WHERE m.product_key = l.product_key AND c.recent = {7 - i}), 0)"
        f" AS month_{i}"
        for i in range(1, 7)
    )
    panel = _other_ctes(_panel(f), UNIFIED_GEO)
    return _query(
        f"""{_filtered(f)}{panel},
ranked AS (
    SELECT product_key, total, {lead} AS leads,
           row_number() OVER (ORDER BY {lead} DESC, total DESC, product_key) AS place
    FROM product_totals
),
listed AS (SELECT * FROM ranked WHERE place <= {limit}),
months AS (
    SELECT year, month, year_month, row_number() OVER (ORDER BY year DESC, month DESC) AS recent
    FROM panel WHERE product_key = (SELECT product_key FROM listed WHERE place = 1)
    QUALIFY recent <= 6
),
months_sold AS (
    SELECT product_key, year, month, {_cents('sum(sales_amount)')} AS sales
    FROM base {ended} GROUP BY product_key, year, month
)""",
        f"""SELECT CAST(place AS INTEGER) AS place, l.product_key, product_name,
       coalesce(product_line, 'Unknown') AS product_line,
       (SELECT string_agg(year_month, ',' ORDER BY year, month) FROM months) AS months,
       {months}
FROM listed l JOIN dim_product p ON l.product_key = p.product_key""",
    )


PUBLISHED_TREND = _query(
    SNAPSHOT_MODULES, "SELECT *, 'spark' AS source, 'trend' AS result_file FROM trend"
)
PUBLISHED_TOP_PRODUCTS = _query(
    SNAPSHOT_MODULES, "SELECT *, 'spark' AS source, 'top_products' AS result_file FROM top_products"
)
PUBLISHED_ALERTS = ALERTS_SNAPSHOT


def served_live(f: Filters) -> str:
    return _query(_channels(f), "SELECT *, 'live' AS source FROM channels")


SNAPSHOT_PEAK_VALLEY = _query(
    SNAPSHOT_MODULES,
    """(SELECT 'peak' AS kind, * FROM trend ORDER BY sales_amount DESC, year, month LIMIT 1)
UNION ALL
(SELECT 'valley', * FROM trend ORDER BY sales_amount, year, month LIMIT 1)""",
)

TREND_EXTREMES = _query(
    SNAPSHOT_MODULES,
    """SELECT 'item' AS kind, * FROM trend
UNION ALL
(SELECT 'peak', * FROM trend ORDER BY sales_amount DESC, year, month LIMIT 1)
UNION ALL
(SELECT 'valley', * FROM trend ORDER BY sales_amount, year, month LIMIT 1)""",
)


def trend_extremes(f: Filters) -> str:
    return _query(
        _trailing(f) + PEAK_VALLEY,
        "SELECT 'item' AS kind, * FROM trend UNION ALL SELECT * EXCLUDE (reason) FROM peak_valley",
    )


def _sold(module: str) -> str:
    return f"""SELECT '{module}' AS module, count(*) AS rows,
       coalesce(CAST(sum(CAST(sales_amount AS DECIMAL(28,2))) AS DOUBLE), 0) AS amount FROM {module}"""


PUBLISHED = (
    _alerts(DEFAULT).replace("geo AS (", "geo_sales AS (").replace("FROM geo ", "FROM geo_sales ")
    + """,
published AS (SELECT * FROM all_products ORDER BY total DESC, product_key LIMIT 50),
modules AS (
    SELECT 'kpis' AS module, 1 AS rows, total_sales AS amount FROM kpis
    UNION ALL """
    + "\n    UNION ALL ".join(_sold(m) for m in ("trend", "channels", "geo_sales"))
    + "\n    UNION ALL "
    + _sold("published").replace("'published'", "'top_products'")
    + """
    UNION ALL SELECT 'alerts', count(*), 0 FROM alerts
)"""
)
RESULT_MANIFEST = _query(PUBLISHED, "SELECT module, rows > 0 AS has_files FROM modules")


def _checksum(module: str, source: str) -> str:
    texts = [
        f"coalesce(CAST({f'CAST({name} AS DECIMAL(38,6))' if kind == 'double' else name} AS VARCHAR), 'NULL')"
        for name, kind in results.fields(module)
    ]
    digest = f"CAST('0x' || left(md5(concat_ws('|', {', '.join(texts)})), 15) AS BIGINT)"
    return f"SELECT '{module}' AS module, count(*) AS rows, CAST(coalesce(sum({digest}), 0) AS VARCHAR) AS checksum FROM {source}"


# The alerts hold JSON, whose numbers SQL writes in another way.
RESULT_CHECKSUMS = _query(
    PUBLISHED,
    " UNION ALL ".join(
        _checksum(module, "published" if module == "top_products" else module)
        for module in ("kpis", "trend", "channels", "top_products", "geo_sales")
    ),
)
OUTPUT_COMPLETENESS = _query(PUBLISHED, "SELECT module, 'ok' AS status, rows FROM modules")
# One module is written without rows and two are not written.
OUTPUT_COMPLETENESS_GAPS = _query(
    PUBLISHED,
    """SELECT module, CASE module WHEN 'channels' THEN 'empty' WHEN 'geo_sales' THEN 'missing'
       WHEN 'alerts' THEN 'missing' ELSE 'ok' END AS status,
       CASE module WHEN 'channels' THEN 0 WHEN 'geo_sales' THEN NULL WHEN 'alerts' THEN NULL
       ELSE rows END AS rows
FROM modules""",
)
REPORT_MODULES = _query(
    PUBLISHED,
    """SELECT CAST(list_position(['kpis', 'trend', 'channels', 'top_products', 'geo_sales', 'alerts'],
                          module) - 1 AS INTEGER) AS position, module,
       CASE WHEN module <> 'kpis' THEN rows END AS items, amount, NULL AS status
FROM modules""",
)
REPORT_MODULES_GAPS = _query(
    PUBLISHED,
    """SELECT CAST(list_position(['kpis', 'trend', 'channels', 'top_products', 'geo_sales', 'alerts'],
                          module) - 1 AS INTEGER) AS position, module,
       CASE WHEN module IN ('channels', 'geo_sales', 'alerts') THEN 0
            WHEN module <> 'kpis' THEN rows END AS items,
       CASE WHEN module IN ('channels', 'geo_sales', 'alerts') THEN 0 ELSE amount END AS amount,
       CASE WHEN module IN ('geo_sales', 'alerts') THEN 'spark_result_missing' END AS status
FROM modules""",
)
REPORT_CONTEXT = _query(
    PUBLISHED,
    """SELECT (SELECT total_sales FROM kpis) AS total_sales,
       (SELECT year_month FROM trend ORDER BY year NULLS FIRST, month NULLS FIRST LIMIT 1) AS first_month,
       (SELECT sales_channel FROM channels ORDER BY sales_amount DESC, sales_channel LIMIT 1) AS first_channel,
       (SELECT product_key FROM published ORDER BY total DESC, product_key LIMIT 1) AS first_product,
       (SELECT city FROM geo_sales ORDER BY sales_amount DESC, country, state_province, city LIMIT 1)
           AS first_city,
       (SELECT type FROM alerts ORDER BY rule_order LIMIT 1) AS first_alert""",
)
