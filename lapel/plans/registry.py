"""Every query by key, bound to the conformed star and to parameters that fit its data."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.functions.metrics import sql_with_metrics
from lapel.functions.money import money, total
from lapel.functions.sql_functions import register_advisor_filter, register_masks, register_sql_functions
from lapel.operators import advisors as A
from lapel.operators import clients as C
from lapel.operators import metric_reports as M
from lapel.operators import policy as P
from lapel.operators import profile as PR
from lapel.operators import revenue as R
from lapel.operators import scoring as S
from lapel.operators import usage as U
from lapel.session import scratch_dir
from lapel.sources import usage_log as L
from lapel.sources.conform import AS_OF, BOUNDS, DOMAIN, ConformedStar
from lapel.sources.star import MappedStar, Star, StoredStar, amount_check, append_batch, cast_dates, fk_check, register_views, row_counts, write_star

Query = Callable[[SparkSession, str], DataFrame]

YEAR_END = date(2001, 7, 31)
CITIES = ("NATION_3", "NATION_7")
LAST_YEAR = 2000
ADVISOR = ("Supplier", "000000000")
ADVISOR_LOGIN = "Supplier.000000003@" + DOMAIN
VIEWER = "viewer@" + DOMAIN
HOME = "NATION_3"
SLOW_MS = 55.0


def _ask(question: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A question of the star as a registered query."""
    return lambda spark, folder: question(ConformedStar(spark, folder), *args, **kwargs)


def _governed(question: Callable[..., DataFrame], rules: Callable[[Star], list[P.Rule]], *args, **kwargs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        star = ConformedStar(spark, folder)
        return question(P.govern(star, *rules(star)), *args, **kwargs)

    return run


def _log(report: Callable[..., DataFrame], *inputs: Callable[..., DataFrame], **kwargs) -> Query:
    """A report over the usage log, with further inputs read from the same folder."""
    return lambda spark, folder: report(
        L.usage_log(spark, folder), *[i(spark, folder) for i in inputs], **kwargs
    )


def _client_view(star: Star) -> DataFrame:
    """The client columns a policy may change."""
    rows = star.clients("client_id", "email", "city", "advisor_id", "lifetime_spend")
    return rows.withColumn("lifetime_spend", money("lifetime_spend"))


def _advisor_sales(star: Star) -> DataFrame:
    rows = star.transactions("advisor_id", "client_id", "total_amount")
    return rows.groupBy("advisor_id", "client_id").agg(money(total("total_amount")).alias("amount"))


def _email_rule(star: Star) -> list[P.Rule]:
    return [P.mask_email(VIEWER, [VIEWER])]


def _spend_rule(star: Star) -> list[P.Rule]:
    return [P.mask_lifetime_spend(VIEWER, [VIEWER])]


def _city_rule(star: Star) -> list[P.Rule]:
    return [P.city_rows(VIEWER, [VIEWER], HOME)]


def _all_rules(star: Star) -> list[P.Rule]:
    return _spend_rule(star) + _email_rule(star) + _city_rule(star)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """The whole fact as declared, money as doubles."""
    return ConformedStar(spark, folder).transactions()


def _cast_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order days written out as text and read back as dates."""
    text = ConformedStar(spark, folder).scan("orders")
    text = text.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))
    return cast_dates(text, "order_day")


def _in_batches(question: Callable[..., DataFrame], *args) -> Query:
    """The same question of a star that is written without some of its sales and returns, of all months, which are
    appended as two batches, the first of them sent twice."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        source = ConformedStar(spark, folder).joined_once()
        fact = source.transactions()
        late = F.coalesce(F.col("payment_method") == "1-URGENT", F.lit(False))
        recent = F.coalesce(F.col("transaction_date") >= date(LAST_YEAR, 1, 1), F.lit(False))
        tables = {name: source.table(name) for name in ("stores", "advisors", "products", "clients")}
        first = MappedStar(spark, {**tables, "transactions": fact.filter(~late & ~recent)})
        star = write_star(first, scratch_dir(spark) + "/star", parts=PR.partial_profiles)
        append_batch(star, "recent", {"transactions": fact.filter(recent & ~late)}, PR.partial_profiles)
        append_batch(star, "late", {"transactions": fact.filter(late)}, PR.partial_profiles)
        append_batch(star, "recent", {"transactions": fact.filter(recent & ~late)}, PR.partial_profiles)
        return question(StoredStar(spark, path=star.path, schemas=star.schemas), *args)

    return run


def _buyers_then_inactive(spark: SparkSession, folder: str) -> DataFrame:
    star = ConformedStar(spark, folder)
    first = C.category_buyers(star, "PROMO", LAST_YEAR)
    return C.buyers_now_inactive(star, first, AS_OF, 90)


def _sql_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """The SQL twin, called from SQL."""
    _sql_setup(spark, folder)
    return spark.sql("SELECT * FROM cf_get_revenue_by_period('ALL', '2000-01-01', '2000-12-31')")


def _sql_top_clients(spark: SparkSession, folder: str) -> DataFrame:
    _sql_setup(spark, folder)
    return spark.sql("SELECT * FROM cf_get_top_clients(p_store_id => 3) WHERE rank <= 10")


def _sql_top_n_clients(spark: SparkSession, folder: str) -> DataFrame:
    _sql_setup(spark, folder)
    return spark.sql("SELECT * FROM cf_get_top_n_clients(p_store_id => 3)")


def _sql_ranked_clients(spark: SparkSession, folder: str) -> DataFrame:
    """All clients of a store, numbered beforehand."""
    C.register_ranked_clients(ConformedStar(spark, folder), AS_OF, BOUNDS, prefix="cf_")
    return spark.sql("SELECT * FROM cf_get_ranked_clients(p_store_id => 3)")


def _sql_risk(spark: SparkSession, folder: str) -> DataFrame:
    _sql_setup(spark, folder)
    return spark.sql(
        f"""SELECT c.client_id, r.days_since_purchase, ROUND(r.lifetime_spend, 2) AS lifetime_spend, r.risk_tier
            FROM cf_clients c, LATERAL cf_classify_client_risk(
                DATEDIFF(DATE '{AS_OF.isoformat()}', c.last_purchase_date), CAST(c.lifetime_spend AS DOUBLE)) r"""
    )


def _sql_setup(spark: SparkSession, folder: str) -> None:
    star = ConformedStar(spark, folder)
    register_views(star, prefix="cf_")
    register_sql_functions(spark, BOUNDS, prefix="cf_", as_of=AS_OF)


def _sql_metric(query: str, as_of: date = AS_OF) -> Query:
    """SQL text that names a metric, over the registered views."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        register_views(ConformedStar(spark, folder), prefix="cf_")
        return sql_with_metrics(spark, query, as_of)

    return run


def _by(group: str, metric: str, source: str = "cf_transactions", cents: bool = False) -> Query:
    shown = f"CAST(ROUND({{{metric}}}, 2) AS DOUBLE)" if cents else f"{{{metric}}}"
    return _sql_metric(f"SELECT {group}, {shown} AS {metric} FROM {source} GROUP BY {group}")


def _masked(call: str) -> Query:
    """A scalar SQL function of a restricted viewer, called for every client."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        register_views(ConformedStar(spark, folder), prefix="cf_")
        register_masks(spark, VIEWER, VIEWER, HOME, prefix="cf_")
        register_advisor_filter(spark, ADVISOR_LOGIN, DOMAIN, prefix="cf_")
        return spark.sql(f"SELECT client_id, {call} FROM cf_clients")

    return run


def _score_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Ten questions answered by other queries: two the same, two equal, six with a known mistake.

    Twenty answers of one star: it is written once, so that none of them derives it again.
    """
    star = write_star(ConformedStar(spark, folder), scratch_dir(spark) + "/star")
    count = F.count(F.lit(1))
    amount = money(total("total_amount"))
    rich = star.clients("lifetime_spend").filter(F.col("lifetime_spend") > BOUNDS.vip)
    joined = star.sales("store_id", "total_amount").join(star.stores("store_id", "store_name", "city"), "store_id")
    stores = joined.groupBy("store_id", "store_name", "city").agg(amount.alias("revenue"))
    with_returns = star.transactions("product_id", "total_amount").groupBy("product_id").agg(amount.alias("revenue"))
    products = star.products("product_id", "product_name", "brand", "category").join(with_returns, "product_id")
    dormant = star.clients("client_segment").filter(F.col("client_segment") == "Dormant")
    cities = star.stores("store_id", "city").filter(F.col("city").isin(*CITIES))
    wrong_key = star.sales("advisor_id", "total_amount").join(cities, F.col("advisor_id") == F.col("store_id"))
    return S.score_answers(
        {
            "bq01": (R.revenue_ytd(star, AS_OF), R.revenue_ytd(star, date(LAST_YEAR, 8, 2))),
            "bq02": (C.vip_count(star), rich.agg(count.alias("vip_client_count"))),
            "bq03": (
                R.top_products(star),
                products.orderBy(F.desc("revenue"), "product_id").limit(5).drop("product_id"),
            ),
            "bq04": (
                R.best_stores(star),
                stores.orderBy(F.desc("revenue"), "store_id").limit(1).drop("store_id"),
            ),
            "bq05": (C.at_risk_count(star), dormant.agg(count.alias("at_risk_count"))),
            "bq06": (C.at_risk_vips(star, AS_OF), C.at_risk_vips(star, AS_OF)),
            "bq07": (R.city_revenue(star, CITIES), wrong_key.groupBy("city").agg(amount.alias("revenue"))),
            "bq08": (A.best_aov_advisors(star), A.best_aov_advisors(star)),
            "bq09": (C.inactive_clients(star, AS_OF), C.inactive_clients(star, AS_OF, 90)),
            "bq10": (R.return_rate_by(star), R.return_rate_by(star, "brand")),
        }
    )


def _verdicts(report: Callable[..., DataFrame], *weeks: str) -> Query:
    return lambda spark, folder: report(L.verdicts(spark, folder, weeks), *weeks)


RUNS = ("2024-01-01", "2024-01-08")

REGISTRY: dict[str, Query] = {
    # sources, integrity
    "scan_table": _scan,
    "cast_dates": _cast_dates,
    "row_counts": _ask(row_counts),
    "fk_check": _ask(fk_check),
    "amount_check": _ask(amount_check),
    # questions
    "q01_revenue_ytd": _ask(R.revenue_ytd, AS_OF),
    "q02_revenue_by_store_12m": _ask(R.revenue_by_store_12m, AS_OF),
    "q02b_revenue_by_store_between": _ask(R.revenue_by_store_between, AS_OF),
    "q03_clients_by_tier": _ask(C.clients_by_tier),
    "q04_top_categories": _ask(R.top_categories, 5),
    "q05_vip_by_city": _ask(C.vip_by_city),
    "q06_top_clients": _ask(C.top_clients, AS_OF),
    "q07_inactive_high_value": _ask(C.inactive_high_value, AS_OF, 180, BOUNDS.vip),
    "q08_advisor_revenue": _ask(A.advisor_revenue),
    "q09_aov_by_category": _ask(R.aov_by_category),
    "q10_city_compare": _ask(R.city_compare, CITIES, AS_OF),
    "q10_city_compare_distinct_ids": _ask(R.city_compare, CITIES, AS_OF, ids_repeat=True),
    "q11a_category_buyers": _ask(C.category_buyers, "PROMO", LAST_YEAR),
    "q11b_buyers_now_inactive": _buyers_then_inactive,
    "q12_advisors_having": _ask(A.advisors_having, 345, 50_000),
    "q13_discount_rate": _ask(R.discount_usage),
    "q14_monthly_trend": _ask(R.monthly_trend, AS_OF, 24),
    "q15_revenue_by_brand": _ask(R.revenue_by_brand),
    "q16_advisor_at_risk_book": _ask(C.advisor_at_risk_book, *ADVISOR, AS_OF),
    "q17_bought_x_never_y": _ask(C.bought_x_never_y, "Brand#1", "PROMO", "SMALL", "Brand#2"),
    "q17_not_in": _ask(C.bought_x_never_y, "Brand#1", "PROMO", "SMALL", "Brand#2", method="not_in"),
    "q17_except": _ask(C.bought_x_never_y, "Brand#1", "PROMO", "SMALL", "Brand#2", method="except"),
    "q18_return_rate": _ask(R.return_rate_by),
    # certified and benchmark questions, preview
    "cq1_at_risk_clients": _ask(C.at_risk_clients, AS_OF),
    "cq2_revenue_by_store_ytd": _ask(R.revenue_by_store_ytd, AS_OF),
    "cq3_advisor_leaderboard": _ask(A.advisor_leaderboard),
    "bq01_revenue_ytd": _ask(R.revenue_ytd, AS_OF, "total_revenue"),
    "bq02_vip_count": _ask(C.vip_count),
    "bq03_top_products": _ask(R.top_products),
    "bq04_best_store": _ask(R.best_stores),
    "bq05_at_risk_count": _ask(C.at_risk_count),
    "bq06_at_risk_vips": _ask(C.at_risk_vips, AS_OF),
    "bq07_city_compare": _ask(R.city_revenue, CITIES),
    "bq08_best_aov_advisor": _ask(A.best_aov_advisors),
    "bq09_inactive_clients": _ask(C.inactive_clients, AS_OF),
    "bq10_return_rate": _ask(R.return_rate_by),
    "client_preview": _ask(C.client_preview),
    "client_preview_governed": _governed(C.client_preview, _all_rules),
    # named metrics
    "metric_revenue": _ask(M.revenue_by),
    "metric_net_revenue": _ask(M.net_revenue_by),
    "metric_aov": _ask(M.aov_by),
    "metric_days_since_last_purchase": _ask(M.days_since_last_purchase, AS_OF),
    "metric_revenue_per_sqft": _ask(M.revenue_per_sqft),
    "metric_revenue_per_sqft_kept": _ask(M.revenue_per_sqft, exclude_returns=True),
    "metric_vip_at_risk_count": _ask(M.vip_at_risk_count),
    "metric_repurchase_rate": _ask(M.repurchase_rate),
    "metric_discount_rate": _ask(M.discount_rate_by),
    "metric_discount_rate_pct": _ask(M.discount_rate_by, as_pct=True),
    "metric_return_rate": _ask(M.return_rate_by),
    "metric_growth_mom_naive": _ask(M.growth_mom_naive, YEAR_END),
    "metric_growth_mom": _ask(M.growth_mom, YEAR_END),
    "metric_growth_mom_series": _ask(M.growth_mom_series),
    "metric_purchase_frequency": _ask(M.purchase_frequency),
    "metric_yoy": _ask(M.yoy, AS_OF),
    "metric_live_client_count": _ask(M.live_client_count),
    "metric_null_defaults": _ask(M.null_defaults),
    # the same by name in SQL text
    "sql_metric_revenue": _by("store_id", "revenue", cents=True),
    "sql_metric_net_revenue": _by("store_id", "net_revenue", cents=True),
    "sql_metric_aov": _by("payment_method", "aov", cents=True),
    "sql_metric_days_since_last_purchase": _sql_metric(
        "SELECT client_id, {days_since_last_purchase} AS days_since_last_purchase FROM cf_clients"
    ),
    "sql_metric_revenue_per_sqft": _sql_metric(
        """SELECT s.store_id, s.store_name, {gross_per_sqft} AS revenue_per_sqft
           FROM cf_transactions t JOIN cf_stores s ON t.store_id = s.store_id
           GROUP BY s.store_id, s.store_name, s.square_footage"""
    ),
    "sql_metric_vip_at_risk_count": _by("city", "vip_at_risk_count", "cf_clients"),
    "sql_metric_repurchase_rate": _by("city", "repurchase_rate", "cf_clients"),
    "sql_metric_discount_rate": _by("payment_method", "discount_rate"),
    "sql_metric_return_rate": _by("store_id", "return_rate"),
    "sql_metric_growth_mom_naive": _sql_metric("SELECT {growth_mom_naive} AS growth_mom_naive FROM cf_transactions", YEAR_END),
    "sql_metric_growth_mom": _sql_metric(
        """SELECT store_id, {growth_mom} AS growth_mom FROM cf_transactions
           WHERE transaction_date >= DATE '2001-06-01' AND transaction_date < DATE '2001-08-01' GROUP BY store_id""",
        YEAR_END,
    ),
    "sql_metric_live_client_count": _sql_metric(
        """SELECT a.advisor_id, a.client_count, COALESCE(b.live, 0) AS live_clients
           FROM cf_advisors a LEFT JOIN (
             SELECT advisor_id, {live_client_count} AS live FROM cf_transactions WHERE NOT is_return GROUP BY advisor_id
           ) b ON a.advisor_id = b.advisor_id"""
    ),
    # classification
    "classify_client_risk": _ask(C.classify_client_risk, AS_OF, BOUNDS),
    "classify_vip_clients": _ask(C.classify_vip_clients, AS_OF, BOUNDS),
    "membership_tier": _ask(C.tier_table, BOUNDS),
    "vip_flags": _ask(C.vip_flags, BOUNDS),
    "segment_clients": _ask(PR.segment_clients, AS_OF, BOUNDS),
    "client_profile": _ask(PR.client_profile),
    # from partial profiles, after appends
    "segment_clients_in_batches": _in_batches(PR.segment_clients, AS_OF, BOUNDS),
    "client_profile_in_batches": _in_batches(PR.client_profile),
    "row_counts_in_batches": _in_batches(row_counts),
    # parameterised functions and rankings
    "get_revenue_by_period": _ask(R.revenue_by_period, "EUROPE", "2000-01-01", "2000-12-31"),
    "get_top_clients": _ask(C.get_top_clients, 3, AS_OF, BOUNDS),
    "get_top_clients_all_stores": _ask(C.top_clients_by_store, AS_OF, BOUNDS),
    "get_top_clients_top_n": _ask(C.top_clients_by_store, AS_OF, BOUNDS, top_n=5),
    "rank_by_revenue": _ask(A.rank_by_revenue),
    "sql_get_revenue_by_period": _sql_revenue,
    "sql_get_top_clients": _sql_top_clients,
    "sql_get_top_n_clients": _sql_top_n_clients,
    "sql_get_ranked_clients": _sql_ranked_clients,
    "sql_classify_client_risk": _sql_risk,
    "sql_mask_email": _masked("cf_mask_email(email) AS email"),
    "sql_mask_lifetime_spend": _masked("cf_mask_lifetime_spend(CAST(lifetime_spend AS DOUBLE)) AS lifetime_spend"),
    "sql_city_row_filter": _masked("cf_city_row_filter(city) AS shown"),
    "sql_advisor_row_filter": _masked("cf_advisor_row_filter(advisor_id) AS shown"),
    # policies
    "policy_advisor_rows": _governed(_client_view, lambda star: [P.own_rows(star, ADVISOR_LOGIN, DOMAIN)]),
    "policy_advisor_rows_sales": _governed(
        _advisor_sales, lambda star: [P.own_rows(star, ADVISOR_LOGIN, DOMAIN, "transactions")]
    ),
    "policy_mask_email": _governed(_client_view, _email_rule),
    "policy_mask_spend": _governed(_client_view, _spend_rule),
    "policy_city_rows": _governed(_client_view, _city_rule),
    "policy_all": _governed(C.top_clients, _all_rules, AS_OF),
    "policy_drop": _ask(_client_view),
    # answer scoring
    "score_answer": _score_answers,
    "score_benchmark": _verdicts(S.score_benchmark),
    "score_compare": _verdicts(S.score_compare, *RUNS),
    "score_delta": _verdicts(S.score_delta, *RUNS),
    # usage log
    "log_question_counts": _log(U.question_counts, L.certified),
    "log_top_questions": _log(U.top_questions, L.certified),
    "log_user_activity": _log(U.user_activity),
    "log_never_seen": _log(U.never_seen, L.roster),
    "log_feedback": _log(U.feedback),
    "log_feedback_daily": _log(U.feedback_daily),
    "log_failures": _log(U.failures),
    "log_runtime": _log(U.runtime, slow_ms=SLOW_MS),
}
