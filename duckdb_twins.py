"""DuckDB counterparts of the registered queries, for checking results.

They state each result the literal way: row-level joins, plain windows, no shared plans.
Money is DOUBLE, counts and ranks BIGINT, dates text, as in ``__spark_entry__._present``.
"""

STAGING = """
stg AS (
  SELECT l_orderkey || '-' || l_linenumber AS order_id,
         'C' || o_custkey AS customer_id,
         'P' || l_partkey || '-' || l_suppkey AS product_id,
         CASE WHEN l_orderkey % 10 = 0 THEN 'PROMO' ELSE p_type END AS category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price,
         CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CAST(18 + o_custkey % 60 AS INTEGER) AS customer_age,
         CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS customer_gender,
         strftime(o_orderdate, '%-d/%-m/%Y') AS order_date,
         CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%-d/%-m/%Y') END
           AS delivered_date,
         CAST(l_quantity AS INTEGER) AS quantity,
         o_orderpriority AS payment_method,
         r_name AS region,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))
                    * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
                    * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN l_partkey % 50 <> 0 THEN CAST(2 + l_linenumber AS DECIMAL(12,2)) END
           AS shipping_cost,
         CASE WHEN l_partkey % 25 = 1 THEN CAST(0 AS DECIMAL(12,2))
              ELSE CAST(round((CAST(l_extendedprice AS DECIMAL(12,2))
                               - CAST(l_quantity AS DECIMAL(6,0))
                                 * CAST(p_retailprice AS DECIMAL(8,2)))
                              * CAST(0.001 AS DECIMAL(4,3)), 2) AS DECIMAL(12,2))
         END AS profit_margin,
         CASE WHEN (o_custkey % 20 = 0 AND l_returnflag IN ('R', 'A'))
                OR (o_custkey % 20 BETWEEN 1 AND 6 AND l_returnflag = 'R')
                OR (o_custkey % 20 BETWEEN 7 AND 12 AND l_returnflag = 'R'
                    AND l_linenumber <= 2)
              THEN 'Yes' ELSE 'No' END AS returned,
         strftime(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER), '%-d/%-m/%Y')
           AS request_date,
         CASE l_suppkey % 6 WHEN 0 THEN 'Defective' WHEN 1 THEN 'Not as described'
              WHEN 2 THEN 'Missing/Wrong item' WHEN 3 THEN 'No longer needed'
              WHEN 4 THEN 'Slow delivery' ELSE 'Other' END AS return_reason,
         l_shipdate AS s1, l_partkey AS s2, l_suppkey AS s3, l_extendedprice AS s4,
         l_quantity AS s5
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

TABLES = STAGING + """,
dedup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY s1, s2, s3, s4, s5) AS copy
    FROM stg)
  WHERE copy = 1
),
ord AS (
  SELECT order_id, customer_id, product_id,
         CAST(try_strptime(order_date, '%d/%m/%Y') AS DATE) AS order_date,
         CAST(try_strptime(delivered_date, '%d/%m/%Y') AS DATE) AS delivered_date,
         quantity, payment_method, region, total_amount, shipping_cost, profit_margin
  FROM dedup
),
ret AS (
  SELECT order_id, CAST(try_strptime(request_date, '%d/%m/%Y') AS DATE) AS request_date,
         return_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY s1, s2, s3, s4, s5) AS copy
        FROM stg WHERE returned = 'Yes')
  WHERE copy = 1
),
votes AS (
  SELECT product_id, category,
         row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, category) AS place
  FROM stg WHERE category IS NOT NULL GROUP BY product_id, category
),
prod AS (
  SELECT v.product_id, v.category, x.price, x.discount
  FROM votes v
  JOIN (SELECT product_id, max(price) AS price, max(discount) AS discount
        FROM stg GROUP BY product_id) x ON v.product_id = x.product_id
  WHERE v.place = 1
),
cust AS (
  SELECT customer_id, max(customer_age) AS customer_age, max(customer_gender) AS customer_gender
  FROM stg GROUP BY customer_id
),
ordret AS (
  SELECT o.*, r.order_id IS NOT NULL AS returned, r.request_date, r.return_reason,
         o.total_amount + o.profit_margin + o.shipping_cost AS economic
  FROM ord o LEFT JOIN ret r ON o.order_id = r.order_id
),
fact AS (
  SELECT f.*, p.category FROM ordret f JOIN prod p ON f.product_id = p.product_id
)"""

LOSS = "coalesce(sum(total_amount) FILTER (returned), 0)"
RETURNS = "count(order_id) FILTER (returned)"


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def rate(numerator: str, denominator: str, digits: int = 4, scale: str = "1.0") -> str:
    return (f"round({dbl(numerator)} * {dbl(scale)} / nullif({dbl(denominator)}, 0.0), {digits})")


def pct(numerator: str, denominator: str) -> str:
    return rate(numerator, denominator, 2, "100.0")


def avg(column: str) -> str:
    return rate(f"sum({column})", f"count({column})", 2)


def risk(rate_column: str, names=("High Risk", "Moderate Risk", "Low Risk")) -> str:
    return (f"CASE WHEN {rate_column} >= 0.5 THEN '{names[0]}' "
            f"WHEN {rate_column} >= 0.2 THEN '{names[1]}' ELSE '{names[2]}' END")


def _tables(body: str, more: str = "") -> str:
    extra = f",\n{more}" if more else ""
    return f"WITH {TABLES}{extra}\n{body}"


COSTS = f"""{dbl("sum(total_amount)")} AS revenue_loss, {dbl("sum(profit_margin)")} AS margin_loss,
  {dbl("sum(shipping_cost)")} AS shipping_loss, {dbl("sum(economic)")} AS total_economic_loss"""

PRODUCTS = f"""ps AS (
  SELECT product_id, category, count(order_id) AS total_orders, {RETURNS} AS return_orders,
         {dbl("sum(total_amount)")} AS gross_revenue, {dbl(LOSS)} AS return_loss
  FROM fact GROUP BY product_id, category
)"""

PRODUCT_RISK = f"""SELECT *, {rate("return_orders", "total_orders")} AS return_rate,
  {rate("return_loss", "gross_revenue")} AS loss_rate,
  {risk("return_orders / nullif(total_orders, 0)")} AS risk_level
FROM ps WHERE total_orders >= 3"""

IMPACT_LABELS = f"""
  CASE WHEN total_returns = 0 THEN 'No Returns' ELSE {risk("return_rate")} END
    AS behavior_segment,
  CASE WHEN total_returns = 0 THEN 'No Impact' WHEN tile = 1 THEN 'High Impact'
       ELSE 'Low Impact' END AS impact_segment"""

IMPACT_COLUMNS = """customer_id, total_orders, total_returns, total_revenue, return_loss,
  return_rate, behavior_segment, impact_segment"""

STAGING_IMPACT = f"""raw AS (
  SELECT customer_id, count(order_id) AS total_orders,
         count(*) FILTER (returned = 'Yes') AS total_returns,
         {dbl("sum(total_amount)")} AS total_revenue,
         {dbl("sum(CASE WHEN returned = 'Yes' THEN total_amount ELSE 0 END)")} AS return_loss
  FROM stg GROUP BY customer_id
),
base AS (
  SELECT *, {rate("total_returns", "total_orders")} AS return_rate FROM raw
),
tiled AS (
  SELECT *, ntile(5) OVER (ORDER BY return_loss DESC NULLS LAST, customer_id) AS tile
  FROM base WHERE total_orders >= 3
),
impact AS (
  SELECT *, {IMPACT_LABELS} FROM tiled WHERE total_returns > 0
  UNION ALL
  SELECT *, 0 AS tile, 'No Returns', 'No Impact' FROM base WHERE total_returns = 0
)"""

CLEAN_IMPACT = f"""base AS (
  SELECT customer_id, count(order_id) AS total_orders, {RETURNS} AS total_returns,
         {dbl("sum(total_amount)")} AS total_revenue, {dbl(LOSS)} AS return_loss,
         {rate(RETURNS, "count(order_id)")} AS return_rate
  FROM ordret GROUP BY customer_id
),
tiled AS (
  SELECT *, ntile(5) OVER (ORDER BY return_loss DESC NULLS LAST, customer_id) AS tile
  FROM base WHERE total_orders >= 3
),
impact AS (SELECT *, {IMPACT_LABELS} FROM tiled)"""

SEGMENTS = f"""SELECT behavior_segment, count(*) AS customers,
  {pct("sum(CAST(return_rate AS DECIMAL(10,4)))", "count(return_rate)")} AS avg_return_rate_pct,
  {dbl("sum(CAST(total_revenue AS DECIMAL(18,2)))")} AS total_revenue,
  {dbl("sum(CAST(return_loss AS DECIMAL(18,2)))")} AS return_loss,
  {pct("sum(CAST(return_loss AS DECIMAL(18,2)))",
       "sum(sum(CAST(return_loss AS DECIMAL(18,2)))) OVER ()")} AS loss_share_pct,
  {rate("sum(CAST(return_loss AS DECIMAL(18,2)))", "count(*)", 2)} AS avg_loss_per_customer
FROM impact GROUP BY behavior_segment"""

COHORTS = """first_order AS (
  SELECT customer_id, min(date_trunc('month', order_date)) AS cohort
  FROM ord GROUP BY customer_id
),
active AS (
  SELECT o.*, f.cohort,
         (year(o.order_date) - year(f.cohort)) * 12 + month(o.order_date) - month(f.cohort)
           AS months_since_first_order
  FROM ordret o JOIN first_order f ON o.customer_id = f.customer_id
)"""

REASONS = f"""count(*) AS return_count, {dbl("sum(total_amount)")} AS return_loss"""

REASON_SEGMENTS = f"""seg AS (
  SELECT customer_id,
         CASE WHEN {RETURNS} = 0 THEN 'No Returns'
              ELSE {risk(rate(RETURNS, "count(order_id)"))} END AS behavior_segment
  FROM ordret GROUP BY customer_id HAVING count(order_id) >= 3
)"""

CATEGORY_COSTS = f"""cc AS (
  SELECT category, count(order_id) AS return_count, {COSTS},
         {avg("profit_margin")} AS avg_margin_per_return
  FROM fact WHERE returned GROUP BY category
)"""

CATEGORY_RANKS = f"""{pct("margin_loss + shipping_loss", "total_economic_loss")}
    AS hidden_cost_pct,
  rank() OVER (ORDER BY total_economic_loss DESC NULLS LAST) AS economic_loss_rank,
  rank() OVER (ORDER BY revenue_loss DESC NULLS LAST) AS revenue_loss_rank"""

TREND = f"""count(order_id) AS total_orders, {RETURNS} AS returned_orders,
  {dbl("sum(total_amount)")} AS gross_revenue, {dbl(LOSS)} AS return_loss"""

RISK_FEATURES = f"""cday AS (
  SELECT DISTINCT customer_id, order_date FROM fact
),
chist AS (
  SELECT d.customer_id, d.order_date,
         (SELECT count(*) FROM fact f WHERE f.customer_id = d.customer_id
            AND f.order_date < d.order_date) AS customer_prior_orders,
         (SELECT count(*) FROM fact f WHERE f.customer_id = d.customer_id AND f.returned
            AND f.request_date < d.order_date) AS customer_prior_returns
  FROM cday d
),
gday AS (
  SELECT category, order_date AS day, count(*) AS placed, 0 AS came_back
  FROM fact GROUP BY category, order_date
  UNION ALL
  SELECT category, request_date, 0, count(*) FROM fact WHERE returned
  GROUP BY category, request_date
),
gtotal AS (
  SELECT category, day, sum(placed) AS placed, sum(came_back) AS came_back
  FROM gday GROUP BY category, day
),
ghist AS (
  SELECT category, day,
         coalesce(sum(placed) OVER w, 0) AS category_prior_orders,
         coalesce(sum(came_back) OVER w, 0) AS category_prior_returns
  FROM gtotal
  WINDOW w AS (PARTITION BY category ORDER BY day
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
feat AS (
  SELECT f.order_id, f.customer_id, f.category, f.order_date, f.total_amount, f.region,
         f.payment_method, f.returned, c.customer_prior_orders, c.customer_prior_returns,
         CAST(g.category_prior_orders AS BIGINT) AS category_prior_orders,
         CAST(g.category_prior_returns AS BIGINT) AS category_prior_returns,
         {dbl("customer_prior_returns")} / nullif({dbl("customer_prior_orders")}, 0.0)
           AS customer_prior_rate,
         {dbl("category_prior_returns")} / nullif({dbl("category_prior_orders")}, 0.0)
           AS category_prior_rate
  FROM fact f
  LEFT JOIN chist c ON f.customer_id = c.customer_id AND f.order_date = c.order_date
  LEFT JOIN ghist g ON f.category = g.category AND f.order_date = g.day
)"""

# Check texts, as in the checks themselves.
FAIL = {
    "dq_01": "FAIL — more orders loaded than unique staging rows",
    "dq_02": "FAIL — duplicate order_ids exist in orders table",
    "dq_03": "FAIL — revenue mismatch between staging and orders table",
    "dq_04": "FAIL — return records exist with no matching order",
    "dq_05": "FAIL — null values found in critical columns",
    "dq_06": "FAIL — orders reference customer_ids not in customers table",
    "dq_07": "FAIL — orders reference product_ids not in products table",
    "dq_08": "FAIL — delivered_date is earlier than order_date on some rows",
    "dq_09": "FAIL — return rate is outside expected range (1%–30%)",
    "dq_10": "FAIL — products have discount values outside [0, 1]",
    "dq_null_amount": "FAIL — null order amounts exist in orders table",
    "dq_malformed": "FAIL — source files hold records that cannot be read",
}


def verdict(condition: str, check: str) -> str:
    return f"CASE WHEN {condition} THEN 'PASS' ELSE '{FAIL[check]}' END AS check_result"


def _count_check(check: str, column: str, source: str) -> str:
    return f"SELECT {verdict('n = 0', check)}, n AS {column} FROM (SELECT count(*) AS n {source})"


def _revenue_check(source: str) -> str:
    return f"""SELECT {verdict("abs(s - o) <= 0.01", "dq_03")}, {dbl("s")} AS staging_revenue,
      {dbl("o")} AS orders_revenue, {dbl("abs(s - o)")} AS difference
    FROM (SELECT (SELECT sum(total_amount) FROM {source}) AS s,
                 (SELECT sum(total_amount) FROM ord) AS o)"""


CHECKS = {
    "dq_01": f"""SELECT {verdict("o <= s", "dq_01")}, s AS staging_unique_orders, o AS orders_count
        FROM (SELECT (SELECT count(DISTINCT order_id) FROM stg) AS s,
                     (SELECT count(*) FROM ord) AS o)""",
    "dq_02": _count_check("dq_02", "duplicate_order_count",
                          "FROM (SELECT order_id FROM ord GROUP BY order_id HAVING count(*) > 1)"),
    "dq_03": _revenue_check("stg"),
    "dq_03_dedup": _revenue_check("dedup"),
    "dq_04": _count_check("dq_04", "orphaned_return_count",
                          "FROM ret r LEFT JOIN ord o ON r.order_id = o.order_id "
                          "WHERE o.order_id IS NULL"),
    "dq_05": f"""SELECT {verdict("a = 0 AND b = 0 AND c = 0", "dq_05")}, a AS missing_customer_id,
          b AS missing_product_id, c AS missing_order_date
        FROM (SELECT CAST(sum(CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS a,
                     CAST(sum(CASE WHEN product_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS b,
                     CAST(sum(CASE WHEN order_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS c
              FROM ord)""",
    "dq_06": _count_check("dq_06", "orphaned_customer_count",
                          "FROM ord o LEFT JOIN cust c ON o.customer_id = c.customer_id "
                          "WHERE c.customer_id IS NULL"),
    "dq_07": _count_check("dq_07", "orphaned_product_count",
                          "FROM ord o LEFT JOIN prod p ON o.product_id = p.product_id "
                          "WHERE p.product_id IS NULL"),
    "dq_08": _count_check("dq_08", "invalid_delivery_date_count",
                          "FROM ord WHERE delivered_date < order_date"),
    "dq_09": f"""SELECT {verdict("rate BETWEEN 0.01 AND 0.30", "dq_09")},
          round(rate * 100, 2) AS return_rate_pct
        FROM (SELECT {dbl(RETURNS)} / nullif(count(order_id), 0) AS rate FROM ordret)""",
    "dq_10": _count_check("dq_10", "invalid_discount_count",
                          "FROM prod WHERE discount < 0 OR discount > 1"),
    "dq_11": f"""SELECT count(*) AS products_with_category_conflicts,
          {pct("count(*)", "(SELECT count(DISTINCT product_id) FROM stg)")} AS pct_of_all_products
        FROM (SELECT product_id FROM stg GROUP BY product_id
              HAVING count(DISTINCT category) > 1)""",
    "dq_null_amount": _count_check("dq_null_amount", "null_amount_count",
                                   "FROM ord WHERE total_amount IS NULL"),
    "dq_unparsed_dates": "SELECT " + ", ".join(
        f"count(*) FILTER (trim({c}) <> '' AND try_strptime({c}, '%d/%m/%Y') IS NULL) "
        f"AS unparsed_{c}" for c in ("order_date", "delivered_date", "request_date"))
        + " FROM stg",
    # the star tables are no files whose records could be malformed
    "dq_malformed": _count_check("dq_malformed", "malformed_record_count", "FROM stg WHERE false"),
}

CHECK_METRICS = {
    "dq_01": ["staging_unique_orders", "orders_count"],
    "dq_02": ["duplicate_order_count"],
    "dq_03": ["staging_revenue", "orders_revenue", "difference"],
    "dq_03_dedup": ["staging_revenue", "orders_revenue", "difference"],
    "dq_04": ["orphaned_return_count"],
    "dq_05": ["missing_customer_id", "missing_product_id", "missing_order_date"],
    "dq_06": ["orphaned_customer_count"],
    "dq_07": ["orphaned_product_count"],
    "dq_08": ["invalid_delivery_date_count"],
    "dq_09": ["return_rate_pct"],
    "dq_10": ["invalid_discount_count"],
    "dq_11": ["products_with_category_conflicts", "pct_of_all_products"],
    "dq_null_amount": ["null_amount_count"],
    "dq_unparsed_dates": ["unparsed_order_date", "unparsed_delivered_date",
                          "unparsed_request_date"],
    "dq_malformed": ["malformed_record_count"],
}
CHECK_NAMES = {
    "dq_01": "row count reconciliation", "dq_02": "duplicate orders",
    "dq_03": "revenue reconciliation",
    "dq_03_dedup": "revenue reconciliation without duplicates",
    "dq_04": "orphaned returns", "dq_05": "missing keys", "dq_06": "orphaned customers",
    "dq_07": "orphaned products", "dq_08": "delivery before order",
    "dq_09": "return rate range", "dq_10": "discount range", "dq_11": "category conflicts",
    "dq_null_amount": "orders without amount",
    "dq_unparsed_dates": "date texts that are not dates",
    "dq_malformed": "malformed records",
}


def _report(**changed: str) -> str:
    ctes = ",\n".join(f"c_{check} AS ({body})" for check, body in {**CHECKS, **changed}.items())
    rows = []
    for check, metrics in CHECK_METRICS.items():
        result = "'INFO'" if check in ("dq_11", "dq_unparsed_dates") else "check_result"
        rows += [f"SELECT '{check}' AS check_id, '{CHECK_NAMES[check]}' AS check_name, "
                 f"{result} AS check_result, '{metric}' AS metric, {dbl(metric)} AS value "
                 f"FROM c_{check}" for metric in metrics]
    return _tables("\nUNION ALL\n".join(rows), ctes)


def _violations() -> str:
    not_null = {"cust": ["customer_id"],
                "prod": ["product_id", "category", "price", "discount"],
                "ord": ["order_id", "customer_id", "product_id", "order_date", "quantity",
                        "total_amount"],
                "ret": ["order_id"]}
    label = {"cust": "customers", "prod": "products", "ord": "orders", "ret": "returns"}
    rows = [(table, "NOT NULL", column, f"FROM {table} WHERE {column} IS NULL")
            for table, columns in not_null.items() for column in columns]
    rows += [("ret", "NOT NULL", "return_id", "FROM ret WHERE order_id IS NULL"),
             ("prod", "CHECK", "discount", "FROM prod WHERE NOT discount BETWEEN 0 AND 1"),
             ("ord", "CHECK", "quantity", "FROM ord WHERE NOT quantity > 0")]
    rows += [(table, "UNIQUE", name, f"FROM (SELECT {key} FROM {table} GROUP BY {key} "
                                     f"HAVING count(*) > 1 AND {key} IS NOT NULL)")
             for table, name, key in [("cust", "customer_id", "customer_id"),
                                      ("prod", "product_id", "product_id"),
                                      ("ord", "order_id", "order_id"),
                                      ("ret", "return_id", "md5(order_id)"),
                                      ("ret", "order_id", "order_id")]]
    rows += [(child, "FOREIGN KEY", key, f"FROM {child} WHERE {key} NOT IN "
                                         f"(SELECT {key} FROM {parent})")
             for child, key, parent in [("ord", "customer_id", "cust"),
                                        ("ord", "product_id", "prod"),
                                        ("ret", "order_id", "ord")]]
    return _tables("\nUNION ALL\n".join(
        f"SELECT '{label[table]}' AS table_name, '{kind}' AS kind, '{column}' AS column_name, "
        f"count(*) AS violations {source}" for table, kind, column, source in rows))


# Declared columns by table; a * marks what must not be null.
DECLARED = {
    "staging": ("stg", "order_id:string customer_id:string product_id:string category:string "
                "price:decimal(12,2) discount:decimal(4,2) customer_age:int "
                "customer_gender:string order_date:string delivered_date:string quantity:int "
                "payment_method:string region:string total_amount:decimal(12,2) "
                "shipping_cost:decimal(12,2) profit_margin:decimal(12,2) returned:string "
                "request_date:string return_reason:string"),
    "customers": ("cust", "*customer_id:string customer_age:int customer_gender:string"),
    "products": ("prod", "*product_id:string *category:string *price:decimal(12,2) "
                 "*discount:decimal(4,2)"),
    "orders": ("ord", "*order_id:string *customer_id:string *product_id:string "
               "*order_date:date delivered_date:date *quantity:int payment_method:string "
               "region:string *total_amount:decimal(12,2) shipping_cost:decimal(12,2) "
               "profit_margin:decimal(12,2)"),
    "returns": ("(SELECT md5(order_id) AS return_id, * FROM ret)",
                "*return_id:string *order_id:string request_date:date return_reason:string"),
}


def _declared_columns() -> str:
    rows = []
    for table, (source, columns) in DECLARED.items():
        for i, column in enumerate(columns.split()):
            name, kind = column.lstrip("*").split(":")
            rows.append(f"""SELECT '{table}' AS table_name, '{name}' AS column_name,
              {i + 1}::BIGINT AS position, '{kind}' AS data_type,
              {'false' if column[0] == '*' else 'true'} AS nullable, true AS as_declared,
              count(*) FILTER ({name} IS NULL) AS null_count,
              {f'count(*) FILTER ({name} IS NULL)' if column[0] == '*' else '0::BIGINT'}
                AS violations
              FROM {source}""")
    return "\nUNION ALL\n".join(rows)


def _layers() -> str:
    return _tables("\nUNION ALL\n".join(
        f"SELECT '{name}' AS layer, CAST(sum(n) AS BIGINT) AS row_count, "
        f"count(order_id) AS distinct_order_ids, "
        f"count(*) FILTER (n > 1) AS repeated_order_ids "
        f"FROM (SELECT order_id, count(*) AS n FROM {source} GROUP BY order_id)"
        for name, source in [("staging", "stg"), ("orders", "ord"),
                             ("staging returned", "stg WHERE returned = 'Yes'"),
                             ("returns", "ret")]))


# Streams wait 93.5 days: a 30-day window is emitted once the latest order date less that
# reaches its end, and an order without return once none can follow within 90 days of it.
KPI_WINDOWS = """windowed AS (
  SELECT *, CAST(time_bucket(INTERVAL 30 DAY, order_date, DATE '1970-01-01') AS DATE)
           AS window_start
  FROM fact
),
finished AS (
  SELECT * FROM windowed
  WHERE window_start + INTERVAL 30 DAY <
        (SELECT max(order_date) FROM ord) - INTERVAL 93 DAY
)"""

# A stream can only hold copies of a return together that lie within its delay of each other.
RETURN_GROUPS = """asked AS (
  SELECT *, CAST(try_strptime(request_date, '%d/%m/%Y') AS DATE) AS day
  FROM stg WHERE returned = 'Yes'
),
apart AS (
  SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY order_id ORDER BY day) > 93
                 THEN 1 ELSE 0 END AS step
  FROM asked
),
grouped AS (
  SELECT *, sum(step) OVER (PARTITION BY order_id ORDER BY day) AS part FROM apart
),
groups AS (
  SELECT order_id, day AS request_date FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id, part ORDER BY s1, s2, s3, s4, s5) AS copy
    FROM grouped)
  WHERE copy = 1
)"""

SPIKES = f"""per_window AS (
  SELECT window_start, category, count(order_id) AS total_orders, {RETURNS} AS returned_orders,
         sum(total_amount) AS revenue, {LOSS} AS loss
  FROM finished GROUP BY window_start, category
),
compared AS (
  SELECT *, CAST(sum(returned_orders) OVER w AS DOUBLE) / sum(total_orders) OVER w AS baseline
  FROM per_window
  WINDOW w AS (PARTITION BY category ORDER BY window_start
               ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
)"""


PAGES = {
    "revenue": ["net_revenue", "return_rate", "monthly_trend", "true_cost"],
    "customers": ["customer_impact", "segment_summary", "top_value_customers",
                  "cohort_retention"],
    "products": ["product_return_risk", "product_leakage_rank", "pareto_loss"],
    "categories": ["category_summary", "category_true_cost", "reason_by_category"],
}


def _enforced() -> str:
    """Every row of the four tables with the first constraint it breaks, or none."""
    def broken(null: list[str], *others: str) -> str:
        return ("CASE " + " ".join([f"WHEN {c} IS NULL THEN 'NOT NULL {c}'" for c in null]
                                   + list(others)) + " END")

    orders = broken(["order_id", "customer_id", "product_id", "order_date", "quantity",
                     "total_amount"], "WHEN quantity <= 0 THEN 'CHECK quantity'",
                    "WHEN customer_id NOT IN (SELECT customer_id FROM cust) "
                    "THEN 'FOREIGN KEY customer_id'",
                    "WHEN product_id NOT IN (SELECT product_id FROM good_products) "
                    "THEN 'FOREIGN KEY product_id'")
    products = broken(["product_id", "category", "price", "discount"],
                      "WHEN discount NOT BETWEEN 0 AND 1 THEN 'CHECK discount'")
    return f"""
      WITH good_products AS (SELECT product_id FROM prod WHERE {products} IS NULL),
      checked AS (SELECT order_id, {orders} AS broken FROM ord)
      SELECT 'customers' AS table_name, {broken(["customer_id"])} AS broken FROM cust
      UNION ALL SELECT 'products', {products} FROM prod
      UNION ALL SELECT 'orders', broken FROM checked
      UNION ALL SELECT 'returns', {broken(["order_id"], "WHEN order_id NOT IN (SELECT order_id "
                                          "FROM checked WHERE broken IS NULL) "
                                          "THEN 'FOREIGN KEY order_id'")} FROM ret"""


def _manifest(sql: dict[str, str]) -> str:
    """Row counts of the stored tables, from the counterparts of the queries behind them."""
    rows = [f"SELECT 'tables' AS page, '{name}' AS mart, count(*) AS row_count FROM {table}"
            for name, table in [("customers", "cust"), ("products", "prod"), ("orders", "ord"),
                                ("returns", "ret")]]
    rows += [f"SELECT '{page}', '{name}', count(*) FROM ({sql[name]})"
             for page, names in PAGES.items() for name in names]
    return _tables("\nUNION ALL\n".join(rows))


STAGING_COLUMNS = f"""order_id, customer_id, product_id, category, {dbl("price")} AS price,
  {dbl("discount")} AS discount, CAST(customer_age AS BIGINT) AS customer_age, customer_gender,
  order_date, delivered_date, CAST(quantity AS BIGINT) AS quantity, payment_method, region,
  {dbl("total_amount")} AS total_amount, {dbl("shipping_cost")} AS shipping_cost,
  {dbl("profit_margin")} AS profit_margin, returned, request_date, return_reason"""

ORDER_COLUMNS = f"""order_id, customer_id, product_id, CAST(order_date AS VARCHAR) AS order_date,
  CAST(delivered_date AS VARCHAR) AS delivered_date, CAST(quantity AS BIGINT) AS quantity,
  payment_method, region, {dbl("total_amount")} AS total_amount,
  {dbl("shipping_cost")} AS shipping_cost, {dbl("profit_margin")} AS profit_margin"""


def twins() -> dict[str, str]:
    t = _tables
    sql = {
        "staging": f"WITH {STAGING} SELECT {STAGING_COLUMNS} FROM stg",
        "customers_dim": t("SELECT customer_id, CAST(customer_age AS BIGINT) AS customer_age, "
                           "customer_gender FROM cust"),
        "products_dim": t(f"SELECT product_id, category, {dbl('price')} AS price, "
                          f"{dbl('discount')} AS discount FROM prod"),
        "category_conflicts": t("""SELECT product_id,
            count(DISTINCT category) AS unique_category_count,
            string_agg(DISTINCT category, ',' ORDER BY category) AS categories_seen
          FROM stg GROUP BY product_id HAVING count(DISTINCT category) > 1"""),
        "orders_dedup": t(f"SELECT {STAGING_COLUMNS} FROM dedup"),
        "orders_clean": t(f"SELECT {ORDER_COLUMNS} FROM ord"),
        "returns_clean": t("SELECT md5(order_id) AS return_id, order_id, CAST(request_date AS VARCHAR) AS request_date, "
                           "return_reason FROM ret"),
        "constraint_report": _violations(),
        "orders_dedup_report": _layers(),
        "order_facts": t(f"""SELECT {ORDER_COLUMNS}, returned,
          CAST(request_date AS VARCHAR) AS request_date, return_reason, category FROM fact"""),

        "total_revenue": t(f"SELECT {dbl('sum(total_amount)')} AS total_revenue FROM ord"),
        "return_loss": t(f"""SELECT {dbl('sum(o.total_amount)')} AS return_loss
          FROM ord o JOIN ret r ON o.order_id = r.order_id"""),
        "net_revenue": t(f"""SELECT {dbl('sum(total_amount)')} AS total_revenue,
          {dbl(LOSS)} AS return_loss, {dbl(f'sum(total_amount) - {LOSS}')} AS net_revenue
          FROM ordret"""),
        "return_rate": t(f"SELECT {rate(RETURNS, 'count(order_id)')} AS return_rate FROM ordret"),

        "top_loss_customers": t(f"""SELECT customer_id, count(*) AS total_returns,
            {dbl('sum(total_amount)')} AS return_loss
          FROM ordret WHERE returned GROUP BY customer_id
          ORDER BY return_loss DESC NULLS LAST, total_returns DESC, customer_id LIMIT 10"""),
        "top_value_customers": t(f"""SELECT customer_id, count(order_id) AS total_orders,
            {dbl('sum(total_amount)')} AS lifetime_value
          FROM ord GROUP BY customer_id
          ORDER BY lifetime_value DESC NULLS LAST, customer_id LIMIT 10"""),
        "customer_return_risk": t(f"""SELECT *, {risk('return_rate',
            ('High Return Risk', 'Moderate Return Risk', 'Low Return Risk'))} AS behavior_segment
          FROM (SELECT customer_id, count(order_id) AS total_orders,
                  {dbl('sum(total_amount)')} AS lifetime_value, {RETURNS} AS return_count,
                  {dbl(LOSS)} AS return_loss, {rate(RETURNS, 'count(order_id)')} AS return_rate
                FROM ordret GROUP BY customer_id HAVING count(order_id) >= 3)"""),
        "customer_return_rate_all": t(f"""SELECT c.customer_id,
            count(o.order_id) AS total_orders, count(r.order_id) AS total_returns,
            {pct('count(r.order_id)', 'count(o.order_id)')} AS return_rate_pct
          FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id
          LEFT JOIN ret r ON o.order_id = r.order_id GROUP BY c.customer_id"""),

        "top_revenue_products": t("""SELECT product_id, category, total_orders, gross_revenue
          FROM ps ORDER BY gross_revenue DESC NULLS LAST, product_id LIMIT 10""", PRODUCTS),
        "top_returned_products": t("""SELECT product_id, category, return_orders, return_loss
          FROM ps ORDER BY return_orders DESC, return_loss DESC, product_id LIMIT 10""",
                                   PRODUCTS),
        "product_return_risk": t(PRODUCT_RISK, PRODUCTS),
        "full_return_products": t(f"""SELECT * FROM ({PRODUCT_RISK})
          WHERE return_orders = total_orders""", PRODUCTS),
        "product_leakage_rank": t(f"""SELECT product_id, category, total_orders, gross_revenue,
            return_orders, return_loss, {rate('return_loss', 'gross_revenue')} AS loss_rate,
            rank() OVER (ORDER BY return_loss DESC) AS loss_rank
          FROM ps WHERE total_orders >= 3 ORDER BY return_loss DESC, product_id LIMIT 10""",
                                  PRODUCTS),
        "product_loss_share": t(f"""SELECT product_id, {dbl('loss')} AS return_loss,
            rank() OVER (ORDER BY loss DESC) AS loss_rank,
            {dbl('sum(loss) OVER ()')} AS total_loss,
            {dbl('loss')} * 100.0 / {dbl('sum(loss) OVER ()')} AS pct_of_total
          FROM (SELECT product_id, sum(CASE WHEN returned THEN total_amount ELSE 0 END) AS loss
                FROM ordret GROUP BY product_id)"""),
        "pareto_loss": t(f"""SELECT product_id, category, {dbl('loss')} AS total_loss,
            {dbl('run')} AS cumulative_loss, {pct('run', 'everything')} AS cumulative_pct
          FROM (SELECT product_id, category, loss, sum(loss) OVER () AS everything,
                  sum(loss) OVER (ORDER BY loss DESC, product_id) AS run
                FROM (SELECT product_id, category, {LOSS} AS loss FROM fact
                      GROUP BY product_id, category) WHERE loss > 0)"""),

        "category_revenue": t(f"""SELECT category, count(order_id) AS total_orders,
            {dbl('sum(total_amount)')} AS total_revenue FROM fact GROUP BY category"""),
        "category_return_rate": t(f"""SELECT category, count(order_id) AS total_orders,
            {RETURNS} AS return_orders, {rate(RETURNS, 'count(order_id)')} AS return_rate
          FROM fact GROUP BY category"""),
        "category_return_impact": t(f"""SELECT category, count(order_id) AS return_orders,
            {dbl('sum(total_amount)')} AS return_loss FROM fact WHERE returned
          GROUP BY category"""),
        "category_summary": t(f"""SELECT category, count(order_id) AS total_orders,
            {RETURNS} AS return_orders, {dbl('sum(total_amount)')} AS gross_revenue,
            {dbl(LOSS)} AS return_loss, {rate(RETURNS, 'count(order_id)')} AS return_rate,
            {rate(LOSS, 'sum(total_amount)')} AS loss_rate
          FROM fact GROUP BY category"""),
        "category_loss_raw": t(f"""SELECT category, {dbl('sum(total_amount)')} AS gross_revenue,
            {dbl('sum(total_amount) FILTER (returned)')} AS return_loss
          FROM fact GROUP BY category"""),

        "fanout_inflated_loss": t(f"""SELECT {dbl('sum(o.total_amount)')} AS inflated_return_loss
          FROM ord o JOIN stg s ON o.order_id = s.order_id WHERE s.returned = 'Yes'"""),
        "fanout_corrected_loss": t(f"""SELECT {dbl('sum(total_amount)')} AS corrected_return_loss
          FROM ord WHERE order_id IN (SELECT order_id FROM stg WHERE returned = 'Yes')"""),
        "fanout_audit": t(f"""SELECT {dbl('a')} AS inflated_sum, {dbl('b')} AS corrected_sum, m
            AS max_copies, {rate('a - b', 'b')} AS inflation_rate
          FROM (SELECT
            (SELECT sum(o.total_amount) FROM ord o
             JOIN stg s ON o.order_id = s.order_id WHERE s.returned = 'Yes') AS a,
            (SELECT sum(total_amount) FROM ord WHERE order_id IN
               (SELECT order_id FROM stg WHERE returned = 'Yes')) AS b,
            (SELECT max(n) FROM (SELECT count(*) AS n FROM stg WHERE returned = 'Yes'
                                 GROUP BY order_id)) AS m)"""),
        "monthly_trend": t(f"""SELECT strftime(order_date, '%Y-%m') AS month, {TREND},
            {dbl(f'sum(total_amount) - {LOSS}')} AS net_revenue,
            {rate(RETURNS, 'count(order_id)')} AS return_rate
          FROM ordret GROUP BY month"""),

        "customer_impact_staging": t(f"SELECT {IMPACT_COLUMNS} FROM impact", STAGING_IMPACT),
        "customer_impact": t(f"SELECT {IMPACT_COLUMNS} FROM impact", CLEAN_IMPACT),
        "segment_summary": t(SEGMENTS, STAGING_IMPACT),

        "cohort_retention": t(f"""SELECT strftime(a.cohort, '%Y-%m-%d') AS cohort_month,
            s.n AS cohort_customers, a.months_since_first_order,
            count(DISTINCT a.customer_id) AS active_customers,
            {pct('count(DISTINCT a.customer_id)', 's.n')} AS retention_rate_pct
          FROM active a
          JOIN (SELECT cohort, count(*) AS n FROM first_order GROUP BY cohort) s
            ON a.cohort = s.cohort
          WHERE a.months_since_first_order > 0
          GROUP BY a.cohort, s.n, a.months_since_first_order""", COHORTS),
        "cohort_size": t("""SELECT strftime(cohort, '%Y-%m-%d') AS cohort_month,
            count(DISTINCT customer_id) AS new_customers_acquired
          FROM first_order GROUP BY cohort""", COHORTS),
        "cohort_return_rate": t(f"""SELECT strftime(cohort, '%Y-%m-%d') AS cohort_month,
            months_since_first_order, count(DISTINCT customer_id) AS active_customers, {TREND},
            {rate(RETURNS, 'count(order_id)')} AS return_rate,
            {rate(LOSS, 'sum(total_amount)')} AS loss_rate
          FROM active GROUP BY cohort, months_since_first_order""", COHORTS),

        "reason_summary": t(f"""SELECT return_reason, count(*) AS return_count,
            {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_returns,
            {dbl('sum(total_amount)')} AS return_loss,
            {pct('sum(total_amount)', 'sum(sum(total_amount)) OVER ()')} AS pct_of_loss,
            {avg('total_amount')} AS avg_order_value
          FROM ordret WHERE returned GROUP BY return_reason"""),
        "reason_by_category": t(f"""SELECT category, return_reason, {REASONS},
            {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY category)')}
              AS pct_within_category
          FROM fact WHERE returned GROUP BY category, return_reason"""),
        "dominant_reason": t(f"""SELECT category, return_reason AS dominant_reason,
            return_count, return_loss
          FROM (SELECT category, return_reason, {REASONS},
                  rank() OVER (PARTITION BY category
                               ORDER BY sum(total_amount) DESC NULLS LAST) AS place
                FROM fact WHERE returned GROUP BY category, return_reason)
          WHERE place = 1"""),
        "reason_by_region": t(f"""SELECT region, return_reason, {REASONS},
            {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY region)')} AS pct_within_region
          FROM ordret WHERE returned GROUP BY region, return_reason"""),
        "reason_by_segment": t(f"""SELECT behavior_segment, return_reason, {REASONS}
          FROM ordret JOIN seg ON ordret.customer_id = seg.customer_id
          WHERE returned GROUP BY behavior_segment, return_reason""", REASON_SEGMENTS),
        "moderate_reason_crosstab": t(f"""SELECT return_reason, {REASONS},
            {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_returns,
            {pct('sum(total_amount)', 'sum(sum(total_amount)) OVER ()')} AS pct_of_loss
          FROM ordret JOIN seg ON ordret.customer_id = seg.customer_id
          WHERE returned AND behavior_segment = 'Moderate Risk' GROUP BY return_reason""",
                                      REASON_SEGMENTS),
        "reason_actions": t(f"""SELECT g.*, coalesce(a.action, 'Unclassified — review manually')
              AS recommended_action
          FROM (SELECT return_reason, {REASONS} FROM ordret WHERE returned
                GROUP BY return_reason) g
          LEFT JOIN (VALUES
            ('Defective',
             'Product / QA team — investigate manufacturing or supplier defects'),
            ('Not as described',
             'Content team — improve product descriptions, images, and sizing guides'),
            ('Missing/Wrong item',
             'Fulfilment / Ops team — audit pick-pack accuracy and shipping labels'),
            ('No longer needed',
             'Policy / CRM team — review return window length and return-rate customer flags'),
            ('Slow delivery',
             'Logistics team — review carrier SLAs and delivery estimates shown at checkout')
          ) a(reason, action) ON g.return_reason = a.reason"""),

        "true_cost": t(f"""SELECT count(*) AS total_returns, {COSTS},
            {avg('total_amount')} AS avg_revenue_loss_per_return,
            {avg('economic')} AS avg_economic_loss_per_return
          FROM ordret WHERE returned"""),
        "category_true_cost": t(f"SELECT *, {CATEGORY_RANKS} FROM cc", CATEGORY_COSTS),
        "category_true_cost_raw": t(f"""SELECT * EXCLUDE (avg_margin_per_return),
            {CATEGORY_RANKS} FROM cc""", CATEGORY_COSTS),
        "margin_bands": t(f"""SELECT margin_band, count(*) AS return_count,
            {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_returns, {COSTS},
            {avg('total_amount')} AS avg_order_value
          FROM (SELECT *, CASE WHEN profit_margin < 0 THEN 'Negative Margin'
                  WHEN profit_margin = 0 THEN 'Zero Margin'
                  WHEN profit_margin <= 10 THEN 'Low Margin (0–10)'
                  WHEN profit_margin <= 50 THEN 'Mid Margin (10–50)'
                  ELSE 'High Margin (50+)' END AS margin_band
                FROM ordret WHERE returned) GROUP BY margin_band"""),
        "margin_adjusted_rate": t(f"""SELECT *,
            {rate('returned_orders', 'total_orders')} AS order_return_rate,
            {rate('revenue_loss', 'gross_revenue')} AS revenue_return_rate,
            {rate('margin_loss', 'gross_margin')} AS margin_return_rate
          FROM (SELECT category, count(order_id) AS total_orders, {RETURNS} AS returned_orders,
                  {dbl('sum(total_amount)')} AS gross_revenue,
                  {dbl('sum(profit_margin)')} AS gross_margin, {dbl(LOSS)} AS revenue_loss,
                  {dbl('coalesce(sum(profit_margin) FILTER (returned), 0)')} AS margin_loss,
                  {dbl('coalesce(sum(shipping_cost) FILTER (returned), 0)')} AS shipping_loss
                FROM fact GROUP BY category)"""),
        "top_economic_losses": t(f"""SELECT order_id, customer_id, category, return_reason,
            {dbl('total_amount')} AS total_amount, {dbl('profit_margin')} AS profit_margin,
            {dbl('shipping_cost')} AS shipping_cost, {dbl('economic')} AS total_economic_loss,
            CAST(order_date AS VARCHAR) AS order_date,
            CAST(request_date AS VARCHAR) AS request_date
          FROM fact WHERE returned AND profit_margin > 0
          ORDER BY economic DESC NULLS LAST, order_id LIMIT 20"""),

        "order_risk_features": t(f"""SELECT * REPLACE ({dbl('total_amount')} AS total_amount,
            CAST(order_date AS VARCHAR) AS order_date) FROM feat""", RISK_FEATURES),
        "order_risk_score": t("""SELECT order_id, customer_id, category,
            CAST(order_date AS VARCHAR) AS order_date, returned,
            (customer_prior_returns + 5.0::DOUBLE * coalesce(category_prior_rate, 0.0))
              / (customer_prior_orders + 5.0::DOUBLE) AS risk_score
          FROM feat""", RISK_FEATURES),
        "sku_month_monitor": t(f"""SELECT *,
            total_orders >= 3 AND coalesce(return_rate >= 0.25, false) AS alert
          FROM (SELECT CASE WHEN grouping(product_id) = 1 THEN 'category' ELSE 'sku' END AS level,
                  month, category, product_id, {TREND},
                  {rate(RETURNS, 'count(order_id)')} AS return_rate,
                  {rate(LOSS, 'sum(total_amount)')} AS loss_rate
                FROM (SELECT *, strftime(order_date, '%Y-%m') AS month FROM fact)
                GROUP BY GROUPING SETS ((month, category, product_id), (month, category)))"""),
        "stream_dedup": t(f"SELECT {STAGING_COLUMNS} FROM dedup"),
        "stream_loss_kpi_ended": t(f"""SELECT CAST(window_start AS VARCHAR) AS window_start,
            CAST(CAST(window_start + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS window_end,
            count(order_id) AS total_orders, {RETURNS} AS returned_orders,
            {dbl('sum(total_amount)')} AS total_revenue, {dbl(LOSS)} AS return_loss,
            {dbl(f'sum(total_amount) - {LOSS}')} AS net_revenue,
            {rate(RETURNS, 'count(order_id)')} AS return_rate
          FROM windowed WHERE order_date IS NOT NULL GROUP BY window_start""", KPI_WINDOWS),
        "stream_chain": t(f"""SELECT CAST(window_start AS VARCHAR) AS window_start,
            CAST(CAST(window_start + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS window_end,
            count(order_id) AS total_orders, {RETURNS} AS returned_orders,
            {dbl('sum(total_amount)')} AS total_revenue, {dbl(LOSS)} AS return_loss,
            {dbl(f'sum(total_amount) - {LOSS}')} AS net_revenue,
            {rate(RETURNS, 'count(order_id)')} AS return_rate
          FROM (SELECT o.order_id, o.total_amount, r.order_id IS NOT NULL AS returned,
                  CAST(time_bucket(INTERVAL 30 DAY, o.order_date, DATE '1970-01-01') AS DATE)
                    AS window_start
                FROM ord o LEFT JOIN groups r ON o.order_id = r.order_id
                  AND r.request_date BETWEEN o.order_date AND o.order_date + 90
                WHERE o.order_date IS NOT NULL)
          GROUP BY window_start""", RETURN_GROUPS),
        "stream_order_returns_ended": t(f"""SELECT o.order_id, o.customer_id,
            {dbl('o.total_amount')} AS total_amount, CAST(o.order_date AS VARCHAR) AS order_date,
            CAST(r.request_date AS VARCHAR) AS request_date, r.return_reason,
            r.order_id IS NOT NULL AS returned
          FROM ord o LEFT JOIN ret r ON o.order_id = r.order_id
            AND r.request_date BETWEEN o.order_date AND o.order_date + 90
          WHERE o.order_date IS NOT NULL"""),
        "stream_loss_kpi": t(f"""SELECT CAST(window_start AS VARCHAR) AS window_start,
            CAST(CAST(window_start + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS window_end,
            count(order_id) AS total_orders, {RETURNS} AS returned_orders,
            {dbl('sum(total_amount)')} AS total_revenue, {dbl(LOSS)} AS return_loss,
            {dbl(f'sum(total_amount) - {LOSS}')} AS net_revenue,
            {rate(RETURNS, 'count(order_id)')} AS return_rate
          FROM finished GROUP BY window_start""", KPI_WINDOWS),
        "stream_order_returns": t(f"""SELECT o.order_id, o.customer_id,
            {dbl('o.total_amount')} AS total_amount, CAST(o.order_date AS VARCHAR) AS order_date,
            CAST(r.request_date AS VARCHAR) AS request_date, r.return_reason,
            r.order_id IS NOT NULL AS returned
          FROM ord o LEFT JOIN ret r ON o.order_id = r.order_id
            AND r.request_date BETWEEN o.order_date AND o.order_date + 90
          WHERE r.order_id IS NOT NULL
             OR o.order_date < least((SELECT max(order_date) FROM ord),
                                     (SELECT max(request_date) FROM ret)) - 183"""),
        "stream_category_spike": t(f"""SELECT CAST(window_start AS VARCHAR) AS window_start,
            CAST(CAST(window_start + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS window_end,
            category, total_orders, returned_orders, {dbl('revenue')} AS total_revenue,
            {dbl('loss')} AS return_loss, {dbl('revenue - loss')} AS net_revenue,
            {rate('returned_orders', 'total_orders')} AS return_rate,
            round(baseline, 4) AS baseline_rate,
            coalesce(CAST(returned_orders AS DOUBLE) / total_orders > 1.5::DOUBLE * baseline,
                     false) AS spike
          FROM compared""", f"{KPI_WINDOWS},\n{SPIKES}"),
        "dq_report": _report(),
    }
    sql.update({check: t(body) for check, body in CHECKS.items()})
    sql["write_marts"] = _manifest(sql)
    sql.update({f"mart_{name}": sql[name] for names in PAGES.values() for name in names})
    # the report page rolls up the cleaned orders, the query of that name the staging rows
    sql["mart_segment_summary"] = t(SEGMENTS, CLEAN_IMPACT)
    sql["load_quarantine"] = t(f"""
      SELECT table_name, coalesce(broken, 'kept') AS rule, count(*) AS row_count
      FROM ({_enforced()}) GROUP BY ALL""")
    sql["clustered_facts"] = sql["order_facts"]
    sql["csv_dq_report"] = _report(dq_malformed=_count_check(
        "dq_malformed", "malformed_record_count", "FROM stg WHERE quantity = 13"))
    sql["staging_csv"] = t(f"""SELECT * REPLACE (
        replace(return_reason, 'Not as ', 'Not as' || chr(10)) AS return_reason,
        replace(payment_method, 'URGENT', '"URGENT"') AS payment_method)
      FROM (SELECT {STAGING_COLUMNS} FROM stg)""")
    sql["schema_report"] = t(_declared_columns())
    sql["versioned_refresh"] = t("""
      SELECT 'staging' AS table_name, 'all' AS part, 2::BIGINT AS version, count(*) AS row_count,
             NULL::DOUBLE AS revenue_1, NULL::DOUBLE AS revenue_2 FROM stg
      UNION ALL SELECT 'customers', 'all', 1, count(*), NULL, NULL FROM cust
      UNION ALL SELECT 'products', 'all', 1, count(*), NULL, NULL FROM prod
      UNION ALL SELECT 'returns', coalesce(strftime(request_date, '%Y-%m'), 'undated'), 1,
             count(*), NULL, NULL FROM ret GROUP BY ALL
      UNION ALL SELECT 'order_facts', part, CASE WHEN part = last THEN 2 ELSE 1 END, count(*),
             sum(total_amount)::DOUBLE,
             sum(total_amount + CASE WHEN part = last THEN 1 ELSE 0 END)::DOUBLE
      FROM (SELECT coalesce(strftime(order_date, '%Y-%m'), 'undated') AS part, total_amount,
                   (SELECT strftime(max(order_date), '%Y-%m') FROM ord) AS last FROM ord)
      GROUP BY part, last""")
    sql["reload"] = t("""
      SELECT 'staging' AS table_name, count(*) AS row_count FROM stg
      UNION ALL SELECT 'customers', count(*) FROM cust
      UNION ALL SELECT 'products', count(*) FROM prod
      UNION ALL SELECT 'returns', count(*) FROM ret
      UNION ALL SELECT 'order_facts', count(*) FROM ord""")
    return sql
