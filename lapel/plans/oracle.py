"""Plain SQL for every registered query, over the raw parquet tables: the yardstick, not the implementation."""

from __future__ import annotations

from lapel.plans import registry as K
from lapel.sources.conform import AS_OF, BOUNDS, SPECIALIZATIONS
from lapel.sources.usage_log import CAUSES

DAY = f"DATE '{AS_OF.isoformat()}'"
B = BOUNDS


def avg(top: str, bottom: str, digits: int = 2) -> str:
    """A quotient rounded half-up: ten decimals first, so that a tie is a tie."""
    return f"CAST(ROUND(CAST(CAST({top} AS DOUBLE) / {bottom} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


def cents(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DOUBLE)"


REV = cents("SUM(total_amount)")
AOV = avg("SUM(total_amount)", "COUNT(*)")
SPEND = f"{cents('lifetime_spend')} AS lifetime_spend"
SINCE = f"CAST({DAY} - last_purchase_date AS INTEGER)"

SKILLS = ", ".join(f"'{s}'" for s in SPECIALIZATIONS)

FACT = f"""
fact AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(o_orderdate AS DATE) AS transaction_date,
         o_custkey AS client_id, s_nationkey AS store_id, l_suppkey AS advisor_id, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS line_price, CAST(l_quantity AS DECIMAL(12,2)) AS line_quantity,
         CAST(l_discount AS DECIMAL(4,2)) * 100 AS discount_pct,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS total_amount,
         o_orderpriority AS payment_method, l_returnflag = 'R' AS is_return
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
sale AS (SELECT * FROM fact WHERE NOT is_return),
store AS (
  SELECT n_nationkey AS store_id, n_name AS store_name, n_name AS city, r_name AS region,
         1000 + 100 * n_nationkey AS square_footage
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
product AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand FROM part),
advisor AS (
  SELECT s_suppkey AS advisor_id, split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
         split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS advisor_name,
         s_nationkey AS store_id,
         ([{SKILLS}])[CAST(s_suppkey % {len(SPECIALIZATIONS)} AS INTEGER) + 1] AS specialization
  FROM supplier),
book AS (SELECT advisor_id, CAST(COUNT(DISTINCT client_id) AS INTEGER) AS live FROM sale GROUP BY advisor_id)
""".strip()

CLIENT = f"""
total AS (
  SELECT client_id, SUM(total_amount) AS spend, CAST(COUNT(*) AS INTEGER) AS n,
         MIN(transaction_date) AS first_day, MAX(transaction_date) AS last_day
  FROM sale WHERE client_id IS NOT NULL GROUP BY client_id),
favour AS (
  SELECT client_id, category FROM (
    SELECT client_id, category,
           ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY COUNT(*) DESC, category) AS place
    FROM sale JOIN product USING (product_id) GROUP BY client_id, category) WHERE place = 1),
pause AS (
  SELECT client_id, gap FROM (
    SELECT client_id, CAST(d - LAG(d) OVER (PARTITION BY client_id ORDER BY d) AS INTEGER) AS gap,
           ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY d DESC) AS back
    FROM (SELECT DISTINCT client_id, transaction_date AS d FROM sale)) WHERE back = 1),
client0 AS (
  SELECT c_custkey AS client_id, split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) AS client_name,
         lower(replace(c_name, '#', '')) || '@example.com' AS email, n_name AS city, r_name AS province,
         c_nationkey AS preferred_store_id, c_custkey % (SELECT COUNT(*) FROM supplier) AS advisor_id,
         COALESCE(spend, 0) AS lifetime_spend, COALESCE(n, 0) AS total_orders, spend, n, gap,
         first_day AS first_purchase_date, last_day AS last_purchase_date, favour.category AS preferred_category,
         CAST({DAY} - last_day AS INTEGER) AS days
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN total ON c_custkey = total.client_id LEFT JOIN favour ON c_custkey = favour.client_id
  LEFT JOIN pause ON c_custkey = pause.client_id),
client AS (
  SELECT *, lifetime_spend > {B.vip} AS is_vip,
         CASE WHEN lifetime_spend > {B.platinum} THEN 'Platinum' WHEN lifetime_spend > {B.gold} THEN 'Gold'
              WHEN lifetime_spend > {B.silver} THEN 'Silver' ELSE 'Classic' END AS membership_tier,
         CASE WHEN days IS NULL THEN NULL
              WHEN days <= 180 AND total_orders < 3 THEN 'New'
              WHEN days <= 180 AND gap > 365 THEN 'Re-engaged'
              WHEN days > 365 THEN 'Dormant'
              WHEN days > 180 AND lifetime_spend > {B.vip} THEN 'At-Risk'
              ELSE 'Active' END AS client_segment,
         CASE WHEN days IS NULL OR days > 365 THEN 'Lost'
              WHEN lifetime_spend >= {B.risk_spend} THEN
                CASE WHEN days <= 90 THEN 'Loyal VIP' WHEN days <= 180 THEN 'High-Value At-Risk' ELSE 'VIP Dormant' END
              WHEN days <= 90 THEN 'Active' WHEN days <= 180 THEN 'Cooling Off' ELSE 'Dormant' END AS risk_tier
  FROM client0),
known AS (
  SELECT client.*, advisor_name, first_name, last_name, store_name
  FROM client JOIN advisor USING (advisor_id) JOIN store ON preferred_store_id = store.store_id)
""".strip()

LOG = f"""
log AS (
  SELECT ts, user_id, 'Q' || regexp_extract(props, '[0-9]+') AS question, CAST(value AS DECIMAL(18,2)) AS runtime_ms,
         event_type = 'error' AS failed,
         CASE event_id % 3 WHEN 0 THEN '{CAUSES[0]}' WHEN 1 THEN '{CAUSES[1]}' ELSE '{CAUSES[2]}' END AS cause,
         CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS rating,
         CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month
  FROM events),
verdict AS (
  SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS run_id, 'Q' || regexp_extract(props, '[0-9]+') AS question_id,
         CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'Fail' WHEN 'view' THEN 'Partial' ELSE 'Pass' END
           AS verdict
  FROM events GROUP BY 1, 2)
""".strip()


def star(body: str) -> str:
    return f"WITH {FACT}, {CLIENT} {body}"


def facts(body: str) -> str:
    return f"WITH {FACT} {body}"


def logs(body: str) -> str:
    return f"WITH {LOG} {body}"


YEAR = f"year(transaction_date) = {AS_OF.year}"
PAST_YEAR = f"transaction_date >= {DAY} - 365"
IN_CITIES = "city IN (" + ", ".join(f"'{c}'" for c in K.CITIES) + ")"


def ytd(name: str) -> str:
    return facts(f"SELECT {REV} AS {name} FROM sale WHERE {YEAR}")


def per_store(where: str, extra: str = "") -> str:
    return facts(
        f"""SELECT store_name, city, region, {REV} AS revenue, COUNT(DISTINCT client_id) AS unique_clients,
                   {AOV} AS avg_order_value {extra}
            FROM sale JOIN store USING (store_id) WHERE {where} GROUP BY store_id, store_name, city, region"""
    )


def rate(attr: str) -> str:
    return f"""SELECT {attr}, COUNT(*) AS total_transactions, COUNT(*) FILTER (is_return) AS "returns",
                      {avg("100 * COUNT(*) FILTER (is_return)", "COUNT(*)", 1)} AS return_rate_pct
               FROM fact JOIN product USING (product_id) GROUP BY {attr}"""


def cross_sell(keep: str) -> str:
    return star(
        f"""SELECT client_name, membership_tier, {SPEND}, preferred_category, advisor_name AS advisor
            FROM client JOIN advisor USING (advisor_id)
            WHERE client_id IN (SELECT client_id FROM sale JOIN product USING (product_id)
                                WHERE brand = 'Brand#1' AND category = 'PROMO')
              AND {keep}"""
    )


Y = "SELECT client_id FROM sale JOIN product USING (product_id) WHERE category = 'SMALL' AND brand = 'Brand#2'"
BUYERS = f"""SELECT client_id FROM sale JOIN product USING (product_id)
             WHERE category = 'PROMO' AND year(transaction_date) = {K.LAST_YEAR}"""


def leaderboard(*names: str, city: bool = False) -> str:
    rows, buyers = names
    place = "store_name, city" if city else "store_name"
    return facts(
        f"""SELECT advisor_name, specialization, {place}, COUNT(*) AS {rows}, {REV} AS total_revenue,
                   {AOV} AS avg_order_value, COUNT(DISTINCT client_id) AS {buyers}
            FROM sale JOIN advisor USING (advisor_id) JOIN store ON advisor.store_id = store.store_id
            GROUP BY advisor_id, advisor_name, specialization, {place}"""
    )


BEST_STORE = f"""SELECT store_name, city, {REV} AS revenue FROM sale JOIN store USING (store_id)
                 GROUP BY store_id, store_name, city ORDER BY revenue DESC, store_id LIMIT 1"""


def best_products(source: str) -> str:
    return f"""SELECT product_name, brand, category, {REV} AS revenue FROM {source} JOIN product USING (product_id)
               GROUP BY product_id, product_name, brand, category ORDER BY revenue DESC, product_id LIMIT 5"""


def inactive(days: int) -> str:
    return f"""SELECT client_name, email, last_purchase_date, {SINCE} AS days_inactive FROM client
               WHERE last_purchase_date < {DAY} - {days}"""


CITY_REVENUE = f"SELECT city, {REV} AS revenue FROM sale JOIN store USING (store_id) WHERE {IN_CITIES} GROUP BY city"
TOP10 = "ORDER BY client.lifetime_spend DESC, client_id LIMIT 10"


def preview(email: str, spend: str, where: str, order: str) -> str:
    return star(
        f"""SELECT client_id, client_name, {email} AS email, city, membership_tier, {spend} AS lifetime_spend,
                   client_segment
            FROM client WHERE is_vip AND {where} ORDER BY {order} LIMIT 10"""
    )


def view(email: str = "email", spend: str = "", where: str = "TRUE") -> str:
    spend = spend or cents("lifetime_spend")
    return star(
        f"SELECT client_id, {email} AS email, city, advisor_id, {spend} AS lifetime_spend FROM client WHERE {where}"
    )


HIDDEN = "'***@***.***'"
NOTHING = "CAST(NULL AS DOUBLE)"
LOGIN = K.ADVISOR_LOGIN.split("@")[0].lower()
OWN = f"(SELECT MIN(advisor_id) FROM advisor WHERE lower(first_name || '.' || last_name) = '{LOGIN}')"


def ranked(group: str, where: str, n: str, rank: bool = True) -> str:
    return star(
        f"""SELECT {group} client_name, email, membership_tier, {SPEND}, total_orders, last_purchase_date, risk_tier,
                   rank
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY preferred_store_id
                                               ORDER BY lifetime_spend DESC, client_id) AS rank FROM client)
            WHERE {where} AND {n}"""
    )


def period(region: str) -> str:
    return facts(
        f"""SELECT store_name, city, {REV} AS total_revenue, COUNT(*) AS transaction_count,
                   COUNT(DISTINCT client_id) AS unique_clients, {AOV} AS avg_order_value
            FROM sale JOIN store USING (store_id)
            WHERE transaction_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND {region}
            GROUP BY store_id, store_name, city"""
    )


def by_fact(group: str, expr: str, name: str) -> str:
    return facts(f"SELECT {group}, {expr} AS {name} FROM fact GROUP BY {group}")


def diff(question: str, expected: str, actual: str, clean: str = "Partial") -> str:
    return f"""SELECT '{question}' AS question_id, CASE WHEN m + x = 0 THEN '{clean}' ELSE 'Fail' END AS verdict,
                      m AS missing_rows, x AS extra_rows
               FROM (SELECT (SELECT COUNT(*) FROM (({expected}) EXCEPT ALL ({actual}))) AS m,
                            (SELECT COUNT(*) FROM (({actual}) EXCEPT ALL ({expected}))) AS x)"""


def same(question: str) -> str:
    return f"""SELECT '{question}' AS question_id, 'Pass' AS verdict, CAST(0 AS BIGINT) AS missing_rows,
                      CAST(0 AS BIGINT) AS extra_rows"""


def revenue_of(year: int) -> str:
    return f"SELECT {REV} AS r FROM sale WHERE year(transaction_date) = {year}"


SCORES = " UNION ALL ".join(
    [
        diff("bq01", revenue_of(AS_OF.year), revenue_of(K.LAST_YEAR)),
        diff(
            "bq02",
            "SELECT COUNT(*) FROM client WHERE is_vip",
            f"SELECT COUNT(*) FROM client WHERE lifetime_spend > {B.vip}",
        ),
        diff("bq03", best_products("sale"), best_products("fact")),
        diff("bq04", BEST_STORE, BEST_STORE),
        diff(
            "bq05",
            "SELECT COUNT(*) FROM client WHERE client_segment = 'At-Risk'",
            "SELECT COUNT(*) FROM client WHERE client_segment = 'Dormant'",
        ),
        same("bq06"),
        diff(
            "bq07",
            CITY_REVENUE,
            f"SELECT city, {REV} FROM sale JOIN store ON advisor_id = store.store_id WHERE {IN_CITIES} GROUP BY city",
        ),
        same("bq08"),
        diff("bq09", inactive(180), inactive(90)),
        diff("bq10", rate("category"), rate("brand")),
    ]
)

RECORDED = "(300 + advisor_id * 37 % 100)"

BOOK_OF = "c_custkey % (SELECT COUNT(*) FROM supplier)"

FK = " UNION ALL ".join(
    f"""SELECT '{name}.{col}' AS foreign_key, '{ref}.{key}' AS refers_to,
               (SELECT COUNT(*) FROM {src} WHERE {expr} IS NOT NULL
                                             AND {expr} NOT IN (SELECT {k} FROM {dst})) AS orphans"""
    for name, col, ref, key, src, expr, dst, k in [
        ("transactions", "client_id", "clients", "client_id", "fact", "client_id", "customer", "c_custkey"),
        ("transactions", "store_id", "stores", "store_id", "fact", "store_id", "nation", "n_nationkey"),
        ("transactions", "advisor_id", "advisors", "advisor_id", "fact", "advisor_id", "supplier", "s_suppkey"),
        ("transactions", "product_id", "products", "product_id", "fact", "product_id", "part", "p_partkey"),
        ("clients", "preferred_store_id", "stores", "store_id", "customer", "c_nationkey", "nation", "n_nationkey"),
        ("clients", "advisor_id", "advisors", "advisor_id", "customer", BOOK_OF, "supplier", "s_suppkey"),
        ("advisors", "store_id", "stores", "store_id", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ]
)

MONTH_TOTALS = """SELECT store_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
                         SUM(total_amount) AS total FROM sale GROUP BY 1, 2"""

ORACLE: dict[str, str] = {
    "scan_table": facts(
        f"""SELECT transaction_id, transaction_date, client_id, store_id, advisor_id, product_id, quantity,
                   {avg("line_price", "NULLIF(line_quantity, 0)")} AS unit_price,
                   CAST(discount_pct AS DOUBLE) AS discount_pct, CAST(total_amount AS DOUBLE) AS total_amount,
                   payment_method, is_return FROM fact"""
    ),
    "cast_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day FROM orders",
    "row_counts": """SELECT 'stores' AS table_name, (SELECT COUNT(*) FROM nation) AS n
        UNION ALL SELECT 'advisors', (SELECT COUNT(*) FROM supplier)
        UNION ALL SELECT 'products', (SELECT COUNT(*) FROM part)
        UNION ALL SELECT 'clients', (SELECT COUNT(*) FROM customer)
        UNION ALL SELECT 'transactions', (SELECT COUNT(*) FROM lineitem)""",
    "fk_check": facts(FK),
    "q01_revenue_ytd": ytd("total_revenue_ytd"),
    "q02_revenue_by_store_12m": per_store(PAST_YEAR),
    "q02b_revenue_by_store_between": facts(
        f"""SELECT store_id, store_name, CAST(SUM(total_amount) AS DOUBLE) AS revenue_last_12_months
            FROM sale JOIN store USING (store_id)
            WHERE transaction_date BETWEEN {DAY} - 364 AND {DAY} GROUP BY store_id, store_name"""
    ),
    "q03_clients_by_tier": star(
        f"""SELECT membership_tier, COUNT(*) AS client_count,
                   {avg("SUM(lifetime_spend)", "COUNT(*)")} AS avg_lifetime_spend,
                   {cents("SUM(lifetime_spend)")} AS total_lifetime_spend FROM client GROUP BY membership_tier"""
    ),
    "q04_top_categories": facts(
        f"""SELECT category, COUNT(*) AS units_sold, {REV} AS total_revenue, {AOV} AS avg_order_value
            FROM sale JOIN product USING (product_id) GROUP BY category ORDER BY total_revenue DESC, category LIMIT 5"""
    ),
    "q05_vip_by_city": star(
        "SELECT city, province, COUNT(*) AS vip_client_count FROM client WHERE is_vip GROUP BY city, province"
    ),
    "q06_top_clients": star(
        f"""SELECT client_id, client_name, membership_tier, client_segment, is_vip, {SPEND}, last_purchase_date,
                   {SINCE} AS days_since_last_purchase, advisor_name AS advisor, store_name
            FROM known ORDER BY known.lifetime_spend DESC, client_id LIMIT 10"""
    ),
    "q07_inactive_high_value": star(
        f"""SELECT client_name, email, membership_tier, {SPEND}, last_purchase_date,
                   {SINCE} AS days_since_last_purchase, preferred_category, advisor_name AS assigned_advisor, store_name
            FROM known WHERE known.lifetime_spend > {B.vip} AND last_purchase_date < {DAY} - 180"""
    ),
    "q08_advisor_revenue": leaderboard("transactions", "unique_clients"),
    "q09_aov_by_category": facts(
        f"""SELECT category, {AOV} AS avg_order_value, {cents("MIN(total_amount)")} AS min_sale,
                   {cents("MAX(total_amount)")} AS max_sale, COUNT(*) AS total_transactions
            FROM sale JOIN product USING (product_id) GROUP BY category"""
    ),
    "q10_city_compare": facts(
        f"""SELECT city, COUNT(*) AS transactions, COUNT(DISTINCT client_id) AS unique_clients, {REV} AS total_revenue,
                   {AOV} AS avg_order_value, COUNT(DISTINCT store_id) AS store_count
            FROM sale JOIN store USING (store_id) WHERE {PAST_YEAR} AND {IN_CITIES} GROUP BY city"""
    ),
    "q10_city_compare_distinct_ids": facts(
        f"""SELECT city, COUNT(DISTINCT transaction_id) AS transactions, COUNT(DISTINCT client_id) AS unique_clients,
                   {REV} AS total_revenue, {AOV} AS avg_order_value, COUNT(DISTINCT store_id) AS store_count
            FROM sale JOIN store USING (store_id) WHERE {PAST_YEAR} AND {IN_CITIES} GROUP BY city"""
    ),
    "q11a_category_buyers": star(
        f"""SELECT client_id, client_name, email, membership_tier, last_purchase_date FROM client
            WHERE client_id IN ({BUYERS})"""
    ),
    "q11b_buyers_now_inactive": star(
        f"""SELECT client_name, email, membership_tier, CAST(lifetime_spend AS DOUBLE) AS lifetime_spend,
                   last_purchase_date, {SINCE} AS days_inactive, advisor_name AS advisor
            FROM client JOIN advisor USING (advisor_id)
            WHERE client_id IN ({BUYERS}) AND last_purchase_date < {DAY} - 90"""
    ),
    "q12_advisors_having": facts(
        f"""SELECT advisor_name, specialization, store_name, CAST({RECORDED} AS INTEGER) AS client_count,
                   {AOV} AS actual_aov, {REV} AS total_revenue
            FROM sale JOIN advisor USING (advisor_id) JOIN store ON advisor.store_id = store.store_id
            GROUP BY advisor_id, advisor_name, specialization, store_name
            HAVING {RECORDED} > 345 AND SUM(total_amount) > 50000 * COUNT(*)"""
    ),
    "q13_discount_rate": facts(
        f"""SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (discount_pct > 0) AS discounted_transactions,
                   {avg("100 * COUNT(*) FILTER (discount_pct > 0)", "COUNT(*)", 1)} AS discount_rate_pct,
                   {avg("SUM(discount_pct) FILTER (discount_pct > 0)", "COUNT(*) FILTER (discount_pct > 0)", 1)}
                     AS avg_discount_when_applied
            FROM sale"""
    ),
    "q14_monthly_trend": facts(
        f"""SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, {REV} AS monthly_revenue,
                   COUNT(DISTINCT client_id) AS unique_clients, COUNT(*) AS transaction_count
            FROM sale WHERE transaction_date >= {DAY} - INTERVAL 24 MONTH GROUP BY 1"""
    ),
    "q15_revenue_by_brand": facts(
        f"""SELECT brand, COUNT(*) AS transactions, {REV} AS total_revenue, {AOV} AS avg_order_value,
                   COUNT(DISTINCT client_id) AS unique_buyers
            FROM sale JOIN product USING (product_id) GROUP BY brand"""
    ),
    "q16_advisor_at_risk_book": star(
        f"""SELECT client_name, email, membership_tier, {SPEND}, last_purchase_date, {SINCE} AS days_since_purchase,
                   preferred_category
            FROM client JOIN advisor USING (advisor_id)
            WHERE first_name = '{K.ADVISOR[0]}' AND last_name = '{K.ADVISOR[1]}' AND client_segment = 'At-Risk'"""
    ),
    "q17_bought_x_never_y": cross_sell(f"NOT EXISTS (SELECT 1 FROM ({Y}) y WHERE y.client_id = client.client_id)"),
    "q17_not_in": cross_sell(f"client_id NOT IN ({Y})"),
    "q17_except": cross_sell(f"client_id IN (SELECT client_id FROM client EXCEPT {Y})"),
    "q18_return_rate": facts(rate("category")),
    "cq1_at_risk_clients": star(
        f"""SELECT client_id, client_name, email, membership_tier, {SPEND}, last_purchase_date,
                   {SINCE} AS days_since_purchase, preferred_category, advisor_name, store_name
            FROM known WHERE client_segment = 'At-Risk'"""
    ),
    "cq2_revenue_by_store_ytd": per_store(YEAR, ", COUNT(*) AS transaction_count"),
    "cq3_advisor_leaderboard": leaderboard("total_transactions", "clients_served", city=True),
    "bq01_revenue_ytd": ytd("total_revenue"),
    "bq02_vip_count": star("SELECT COUNT(*) AS vip_client_count FROM client WHERE is_vip"),
    "bq03_top_products": facts(best_products("sale")),
    "bq04_best_store": facts(BEST_STORE),
    "bq05_at_risk_count": star("SELECT COUNT(*) AS at_risk_count FROM client WHERE client_segment = 'At-Risk'"),
    "bq06_at_risk_vips": star(
        f"""SELECT client_name, email, CAST(lifetime_spend AS DOUBLE) AS lifetime_spend, last_purchase_date,
                   {SINCE} AS days_inactive FROM client WHERE is_vip AND client_segment = 'At-Risk'"""
    ),
    "bq07_city_compare": facts(CITY_REVENUE),
    "bq08_best_aov_advisor": facts(
        f"""SELECT advisor_name, {AOV} AS avg_order_value FROM sale JOIN advisor USING (advisor_id)
            GROUP BY advisor_id, advisor_name ORDER BY avg_order_value DESC, advisor_id LIMIT 1"""
    ),
    "bq09_inactive_clients": star(inactive(180)),
    "bq10_return_rate": facts(rate("category")),
    "client_preview": preview(
        "email", "CAST(lifetime_spend AS DOUBLE)", "TRUE", "client.lifetime_spend DESC, client_id"
    ),
    "client_preview_governed": preview(HIDDEN, NOTHING, f"city = '{K.HOME}'", "client_id"),
    "metric_revenue": by_fact(
        "store_id", cents("SUM(CASE WHEN is_return THEN 0 ELSE total_amount END)"), "revenue"
    ),
    "metric_net_revenue": by_fact(
        "store_id", cents("SUM(CASE WHEN is_return THEN -total_amount ELSE total_amount END)"), "net_revenue"
    ),
    "metric_aov": by_fact(
        "payment_method",
        avg("SUM(total_amount) FILTER (NOT is_return)", "COUNT(*) FILTER (NOT is_return)"),
        "aov",
    ),
    "metric_days_since_last_purchase": star(f"SELECT client_id, {SINCE} AS days_since_last_purchase FROM client"),
    "metric_revenue_per_sqft": facts(
        """SELECT store_id, store_name, CAST(SUM(total_amount) AS DOUBLE) / square_footage AS revenue_per_sqft
           FROM fact JOIN store USING (store_id) GROUP BY store_id, store_name, square_footage"""
    ),
    "metric_revenue_per_sqft_kept": facts(
        """SELECT store_id, store_name, CAST(SUM(total_amount) AS DOUBLE) / square_footage AS revenue_per_sqft
           FROM sale JOIN store USING (store_id) GROUP BY store_id, store_name, square_footage"""
    ),
    "metric_vip_at_risk_count": star(
        """SELECT city, COUNT(*) FILTER (is_vip AND client_segment = 'At-Risk') AS vip_at_risk_count
           FROM client GROUP BY city"""
    ),
    "metric_repurchase_rate": star(
        """SELECT city, CAST(COUNT(*) FILTER (total_orders > 1) AS DOUBLE) / COUNT(*) AS repurchase_rate
           FROM client GROUP BY city"""
    ),
    "metric_discount_rate": by_fact(
        "payment_method", "CAST(COUNT(*) FILTER (discount_pct > 0) AS DOUBLE) / COUNT(*)", "discount_rate"
    ),
    "metric_discount_rate_pct": by_fact(
        "payment_method", "CAST(100 * COUNT(*) FILTER (discount_pct > 0) AS DOUBLE) / COUNT(*)", "discount_rate"
    ),
    "metric_return_rate": by_fact(
        "store_id", "CAST(100 * COUNT(*) FILTER (is_return) AS DOUBLE) / COUNT(*)", "return_rate"
    ),
    "metric_growth_mom_naive": facts(
        """SELECT (now - past) / NULLIF(past, 0) AS growth_mom_naive
           FROM (SELECT CAST(SUM(total_amount) FILTER (month(transaction_date) = 7) AS DOUBLE) AS now,
                        CAST(SUM(total_amount) FILTER (month(transaction_date) = 7) AS DOUBLE) AS past FROM fact)"""
    ),
    "metric_growth_mom": facts(
        """SELECT store_id, CAST(ROUND(now, 2) AS DOUBLE) AS current_month,
                  CAST(ROUND(past, 2) AS DOUBLE) AS prior_month,
                  CAST(now - past AS DOUBLE) / NULLIF(CAST(past AS DOUBLE), 0) AS growth_mom
           FROM (SELECT store_id,
                        SUM(CASE WHEN month(transaction_date) = 7 AND NOT is_return THEN total_amount ELSE 0 END) AS now,
                        SUM(CASE WHEN month(transaction_date) = 6 AND NOT is_return THEN total_amount ELSE 0 END) AS past
                 FROM fact WHERE transaction_date >= DATE '2001-06-01' AND transaction_date < DATE '2001-08-01'
                 GROUP BY store_id)"""
    ),
    "metric_growth_mom_series": facts(
        f"""SELECT a.store_id, a.month, CAST(ROUND(a.total, 2) AS DOUBLE) AS revenue,
                   CAST(a.total - b.total AS DOUBLE) / NULLIF(CAST(b.total AS DOUBLE), 0) AS growth_mom
            FROM ({MONTH_TOTALS}) a LEFT JOIN ({MONTH_TOTALS}) b
              ON a.store_id IS NOT DISTINCT FROM b.store_id AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)"""
    ),
    "metric_purchase_frequency": facts(
        """SELECT client_id, CAST(year(transaction_date) AS INTEGER) AS year, COUNT(*) AS purchases
           FROM sale WHERE client_id IS NOT NULL GROUP BY 1, 2"""
    ),
    "metric_yoy": facts(
        f"""SELECT store_id, CASE year(transaction_date) WHEN {AS_OF.year} THEN 'Current Year' ELSE 'Prior Year' END
                     AS period, {REV} AS revenue
            FROM sale WHERE year(transaction_date) IN ({AS_OF.year}, {AS_OF.year - 1}) GROUP BY 1, 2"""
    ),
    "metric_live_client_count": facts(
        f"""SELECT advisor_id, CAST({RECORDED} AS INTEGER) AS client_count,
                   CAST(COALESCE(live, 0) AS BIGINT) AS live_clients
           FROM advisor LEFT JOIN book USING (advisor_id)"""
    ),
    "metric_null_defaults": star(
        f"""SELECT client_id, {SPEND}, total_orders, COALESCE(preferred_category, 'Unknown') AS preferred_category
            FROM client"""
    ),
    "classify_client_risk": star(f"SELECT client_id, days AS days_since_purchase, {SPEND}, risk_tier FROM client"),
    "classify_vip_clients": star(
        f"""SELECT client_name, CAST(lifetime_spend AS DOUBLE) AS lifetime_spend, last_purchase_date, risk_tier
            FROM client WHERE is_vip {TOP10}"""
    ),
    "membership_tier": star(f"SELECT client_id, {SPEND}, membership_tier AS tier FROM client"),
    "vip_flags": star(
        f"SELECT client_id, is_vip, is_vip AND lifetime_spend > {B.vvip} AS is_vvip FROM client"
    ),
    "segment_clients": star(
        """SELECT client_id, days AS days_since_last, CAST(n AS BIGINT) AS total_orders, gap, is_vip, client_segment
           FROM client WHERE n IS NOT NULL"""
    ),
    "client_profile": star(
        f"""SELECT client_id, {SPEND}, CAST(n AS BIGINT) AS total_orders, {avg("spend", "n")} AS avg_order_value,
                   first_purchase_date, last_purchase_date, preferred_category FROM client WHERE n IS NOT NULL"""
    ),
    "get_revenue_by_period": period("region = 'EUROPE'"),
    "get_top_clients": ranked("", "preferred_store_id = 3", "TRUE"),
    "get_top_clients_all_stores": ranked("preferred_store_id,", "TRUE", "TRUE"),
    "get_top_clients_top_n": ranked("preferred_store_id,", "TRUE", "rank <= 5"),
    "rank_by_revenue": facts(
        f"""SELECT advisor_id, advisor_name, {REV} AS total_revenue,
                   ROW_NUMBER() OVER (ORDER BY SUM(total_amount) DESC, advisor_id) AS rank
            FROM sale JOIN advisor USING (advisor_id) GROUP BY advisor_id, advisor_name"""
    ),
    "sql_get_revenue_by_period": period("TRUE"),
    "sql_get_top_clients": f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({ranked('', 'preferred_store_id = 3', 'rank <= 10')})",
    "sql_classify_client_risk": star(f"SELECT client_id, days AS days_since_purchase, {SPEND}, risk_tier FROM client"),
    "sql_mask_email": f"SELECT client_id, {HIDDEN} AS email FROM (SELECT c_custkey AS client_id FROM customer)",
    "sql_mask_lifetime_spend": f"SELECT c_custkey AS client_id, {NOTHING} AS lifetime_spend FROM customer",
    "sql_city_row_filter": f"""SELECT c_custkey AS client_id, n_name = '{K.HOME}' AS shown
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "sql_advisor_row_filter": facts(f"SELECT c_custkey AS client_id, {BOOK_OF} = {OWN} AS shown FROM customer"),
    "policy_advisor_rows": view(where=f"advisor_id = {OWN}"),
    "policy_advisor_rows_sales": facts(
        f"""SELECT advisor_id, client_id, {cents("SUM(total_amount)")} AS amount FROM fact
            WHERE advisor_id = {OWN} GROUP BY advisor_id, client_id"""
    ),
    "policy_mask_email": view(email=HIDDEN),
    "policy_mask_spend": view(spend=NOTHING),
    "policy_city_rows": view(where=f"city = '{K.HOME}'"),
    "policy_all": star(
        f"""SELECT client_id, client_name, membership_tier, client_segment, is_vip, {NOTHING} AS lifetime_spend,
                   last_purchase_date, {SINCE} AS days_since_last_purchase, advisor_name AS advisor, store_name
            FROM known WHERE city = '{K.HOME}' ORDER BY client_id LIMIT 10"""
    ),
    "policy_drop": view(),
    "score_answer": star(SCORES),
    "score_benchmark": logs(
        """SELECT run_id, questions, passed, CASE WHEN passed * 10 >= questions * 8 THEN 'production-ready'
                  WHEN passed * 10 >= questions * 5 THEN 'add certified queries' ELSE 'review instructions' END AS band
           FROM (SELECT run_id, COUNT(*) AS questions, COUNT(*) FILTER (verdict = 'Pass') AS passed
                 FROM verdict GROUP BY run_id)"""
    ),
    "score_compare": logs(
        f"""SELECT question_id, a.verdict AS before, b.verdict AS after,
                   COALESCE(a.verdict = 'Pass', FALSE) AND NOT COALESCE(b.verdict = 'Pass', FALSE) AS regressed,
                   COALESCE(b.verdict = 'Pass', FALSE) AND NOT COALESCE(a.verdict = 'Pass', FALSE) AS improved
            FROM (SELECT * FROM verdict WHERE run_id = '{K.RUNS[0]}') a
            FULL JOIN (SELECT * FROM verdict WHERE run_id = '{K.RUNS[1]}') b USING (question_id)"""
    ),
    "score_delta": logs(
        f"""SELECT COUNT(*) FILTER (a) AS passed_before, COUNT(*) FILTER (b) AS passed_after,
                   COUNT(*) FILTER (b) - COUNT(*) FILTER (a) AS delta,
                   COUNT(*) FILTER (a AND NOT b) AS regressions, COUNT(*) FILTER (b AND NOT a) AS improvements
            FROM (SELECT question_id, bool_or(run_id = '{K.RUNS[0]}' AND verdict = 'Pass') AS a,
                         bool_or(run_id = '{K.RUNS[1]}' AND verdict = 'Pass') AS b FROM verdict GROUP BY question_id)"""
    ),
    "log_question_counts": logs(
        """SELECT week, question, COUNT(*) AS asked,
                  question IN (SELECT 'Q' || n_nationkey FROM nation) AS is_certified
           FROM log GROUP BY week, question"""
    ),
    "log_top_questions": logs(
        """SELECT * FROM (
             SELECT week, question, COUNT(*) AS asked,
                    ROW_NUMBER() OVER (PARTITION BY week ORDER BY COUNT(*) DESC, question) AS rank
             FROM log WHERE question NOT IN (SELECT 'Q' || n_nationkey FROM nation) GROUP BY week, question)
           WHERE rank <= 5"""
    ),
    "log_user_activity": logs(
        """SELECT month, user_id, COUNT(*) AS questions, COUNT(DISTINCT CAST(ts AS DATE)) AS active_days,
                  COUNT(DISTINCT CAST(ts AS DATE)) >= 3 AS is_power_user FROM log GROUP BY month, user_id"""
    ),
    "log_never_seen": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "log_feedback": logs(
        """SELECT question, COUNT(*) FILTER (rating = 1) AS up, COUNT(*) FILTER (rating = -1) AS down,
                  CAST(COUNT(*) FILTER (rating = 1) AS DOUBLE) / COUNT(rating) AS up_rate
           FROM log WHERE rating IS NOT NULL GROUP BY question"""
    ),
    "log_feedback_daily": logs(
        """SELECT CAST(ts AS DATE) AS day, COUNT(*) FILTER (rating = 1) AS up, COUNT(*) FILTER (rating = -1) AS down
           FROM log WHERE rating IS NOT NULL GROUP BY 1"""
    ),
    "log_failures": logs(
        """SELECT week, question, cause AS failure_cause, COUNT(*) AS failures FROM log WHERE failed
           GROUP BY week, question, cause"""
    ),
    "log_runtime": logs(
        f"""SELECT *, avg_runtime_ms > {K.SLOW_MS} AS is_slow
            FROM (SELECT month, question, COUNT(*) AS runs, {avg("SUM(runtime_ms)", "COUNT(*)")} AS avg_runtime_ms
                  FROM log GROUP BY month, question)"""
    ),
}

# The same answers by another way: SQL text that names a metric, a function that stops at ten, a star written in batches.
ORACLE |= {
    "amount_check": facts(
        """SELECT COUNT(*) AS n, COUNT(*) FILTER (total_amount * 10000 <> FLOOR(total_amount * 10000)) AS more_decimals,
                  COUNT(*) FILTER (total_amount >= 900000000000) AS large, COUNT(*) FILTER (total_amount IS NULL) AS missing
           FROM fact"""
    ),
    **{f"sql_{key}": ORACLE[key] for key in ORACLE if key.startswith("metric_") and f"sql_{key}" in K.REGISTRY},
    "sql_metric_growth_mom": f"SELECT store_id, growth_mom FROM ({ORACLE['metric_growth_mom']})",
    "sql_get_top_n_clients": ORACLE["sql_get_top_clients"],
    "sql_get_ranked_clients": f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({ORACLE['get_top_clients']})",
    "segment_clients_in_batches": ORACLE["segment_clients"],
    "client_profile_in_batches": ORACLE["client_profile"],
    "row_counts_in_batches": ORACLE["row_counts"],
}
