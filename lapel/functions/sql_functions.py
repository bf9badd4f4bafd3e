"""SQL twins of the parameterised functions, for free SQL over the tables or over registered views.

Spark inlines SQL functions into the calling query, so a row-wise call is a projection. They are temporary, over the
views of ``register_views``, or permanent in a namespace, over its tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from lapel.functions.classify import HOUSE, LOST, RISK_BANDS, Bounds
from lapel.functions.money import SUM


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def risk_sql(days: str, spend: str, bounds: Bounds = HOUSE) -> str:
    """The risk rule as SQL text."""
    arms = []
    for limit, high, low in RISK_BANDS:
        rest = "" if limit == RISK_BANDS[-1][0] else f" AND {spend} < {bounds.risk_spend}"
        arms.append(f"WHEN {days} <= {limit} AND {spend} >= {bounds.risk_spend} THEN '{high}'")
        arms.append(f"WHEN {days} <= {limit}{rest} THEN '{low}'")
    return f"CASE {' '.join(arms)} ELSE '{LOST}' END"


def register_sql_functions(
    spark: SparkSession, bounds: Bounds = HOUSE, prefix: str = "", as_of: date | None = None, top_n: int = 10
) -> None:
    """Temporary classify_client_risk, get_revenue_by_period, get_top_clients, get_top_n_clients over the registered views.

    The last two count days up to ``as_of``, or up to the day of the call.
    """
    _create(spark, "TEMPORARY FUNCTION", prefix, bounds, as_of, top_n)


def create_sql_functions(
    spark: SparkSession, namespace: str, bounds: Bounds = HOUSE, as_of: date | None = None, top_n: int = 10
) -> None:
    """The same, permanent, over the tables of a namespace, which are read at each call.

    Spark calls a table function by its bare name: ``USE`` the namespace first.
    """
    _create(spark, "FUNCTION", f"{namespace}.", bounds, as_of, top_n)


def _create(spark: SparkSession, kind: str, prefix: str, bounds: Bounds, as_of: date | None, top_n: int) -> None:
    """get_top_clients numbers a store by a window. Asked with ``rank <= n``, each task drops what cannot be among the n
    first before the store's rows meet; asked for all ranks, a store is one task's, so for large stores that is what
    ``top_clients_by_store`` is for. get_top_n_clients stops at ``top_n`` by itself: ORDER BY and LIMIT, a few rows per
    task."""
    day = f"DATE '{as_of.isoformat()}'" if as_of else "CURRENT_DATE()"
    days = f"DATEDIFF({day}, last_purchase_date)"
    spark.sql(f"""
        CREATE OR REPLACE {kind} {prefix}classify_client_risk(p_days_since_purchase INT, p_lifetime_spend DOUBLE)
        RETURNS TABLE (days_since_purchase INT, lifetime_spend DOUBLE, risk_tier STRING)
        RETURN SELECT p_days_since_purchase, p_lifetime_spend,
                      {risk_sql("p_days_since_purchase", "p_lifetime_spend", bounds)}""")
    spark.sql(f"""
        CREATE OR REPLACE {kind} {prefix}get_revenue_by_period(p_region STRING, p_start_date STRING, p_end_date STRING)
        RETURNS TABLE (store_name STRING, city STRING, total_revenue DOUBLE, transaction_count BIGINT,
                       unique_clients BIGINT, avg_order_value DOUBLE)
        RETURN
          SELECT s.store_name, s.city, CAST(ROUND(f.total, 2) AS DOUBLE), f.n, f.buyers,
                 CAST(ROUND(f.total / f.valued, 2) AS DOUBLE)
          FROM (SELECT t.store_id, CAST(SUM(CAST(total_amount AS {SUM})) AS {SUM}) AS total, COUNT(*) AS n,
                       COUNT(DISTINCT client_id) AS buyers, NULLIF(COUNT(total_amount), 0) AS valued
                FROM {prefix}transactions t JOIN {prefix}stores r ON t.store_id = r.store_id
                WHERE NOT is_return AND transaction_date >= CAST(p_start_date AS DATE)
                  AND transaction_date <= CAST(p_end_date AS DATE) AND p_region IN ('ALL', r.region)
                GROUP BY t.store_id) f
          JOIN {prefix}stores s USING (store_id)""")
    order = "lifetime_spend DESC NULLS LAST, client_id"
    book = f"{prefix}clients WHERE preferred_store_id = p_store_id"
    for name, source in (("get_top_clients", book), ("get_top_n_clients", f"(SELECT * FROM {book} ORDER BY {order} LIMIT {top_n})")):
        spark.sql(f"""
            CREATE OR REPLACE {kind} {prefix}{name}(p_store_id INT)
            RETURNS TABLE (client_name STRING, email STRING, membership_tier STRING, lifetime_spend DOUBLE,
                           total_orders INT, last_purchase_date DATE, risk_tier STRING, rank INT)
            RETURN
              SELECT CONCAT(first_name, ' ', last_name), email, membership_tier,
                     CAST(ROUND(CAST(lifetime_spend AS {SUM}), 2) AS DOUBLE), total_orders, last_purchase_date,
                     {risk_sql(days, "lifetime_spend", bounds)},
                     ROW_NUMBER() OVER (PARTITION BY preferred_store_id ORDER BY {order})
              FROM {source}""")


def register_masks(spark: SparkSession, user: str, restricted: str, city: str, prefix: str = "") -> None:
    """mask_email, mask_lifetime_spend and city_row_filter as temporary scalar functions for one viewer."""
    hit = f"LOWER({quoted(user)}) = LOWER({quoted(restricted)})"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}mask_email(v STRING) RETURNS STRING
                  RETURN IF({hit}, '***@***.***', v)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}mask_lifetime_spend(v DOUBLE) RETURNS DOUBLE
                  RETURN IF({hit}, NULL, v)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}city_row_filter(v STRING) RETURNS BOOLEAN
                  RETURN NOT {hit} OR v = {quoted(city)}""")


def register_advisor_filter(spark: SparkSession, user: str, domain: str, prefix: str = "") -> None:
    """advisor_row_filter(advisor_id): does the row belong to the advisor whose login is ``user``?

    NULL, hence no row, for an unknown login; of several advisors with one login the lowest id counts.
    """
    login = f"LOWER(first_name) || '.' || LOWER(last_name) || {quoted('@' + domain)}"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}advisor_row_filter(v BIGINT) RETURNS BOOLEAN
                  RETURN v = (SELECT MIN(advisor_id) FROM {prefix}advisors WHERE {login} = {quoted(user.lower())})""")
