"""Row filters, masks and their order."""

from __future__ import annotations

from lapel.operators import clients as C
from lapel.operators import policy as P
from lapel.operators import revenue as R
from lapel.sources.catalogue import TODAY
from tests.conftest import rows
from tests.test_edges import ADVISORS, client, sale, star

DOMAIN = "house.com"


def test_advisor_sees_own_rows(spark):
    people = [client(1), client(2, advisor=2), client(3, advisor=None)]
    s = star(spark, [sale(1, 1, advisor=1), sale(2, 1, advisor=2)], people)
    assert [a["last_name"] for a in ADVISORS] == ["Roe", "Roe"]  # one login, two advisors: the lower id counts
    rules = [P.own_rows(s, "MAX.Roe@House.com", DOMAIN, t) for t in ("clients", "transactions")]
    mine = P.govern(s, *rules)
    assert [r.client_id for r in mine.clients("client_id").collect()] == [1]
    assert [r.transaction_id for r in mine.transactions("transaction_id").collect()] == ["T1"]
    assert mine.stores().count() == 3


def test_unknown_user_sees_nothing(spark, sample):
    rules = [P.own_rows(sample, "nobody@house.com", DOMAIN, t) for t in ("clients", "transactions")]
    seen = P.govern(sample, *rules)
    assert seen.clients().count() == 0
    assert rows(R.revenue_ytd(seen, TODAY)) == [(None,)]


def test_masks_apply_to_the_restricted_only(sample):
    for user, hidden in (("Viewer@x.com", True), ("admin@x.com", False)):
        rules = [P.mask_email(user, ["viewer@X.com"]), P.mask_lifetime_spend(user, ["viewer@X.com"])]
        rules.append(P.city_rows(user, ["viewer@X.com"], "Toronto"))
        seen = P.govern(sample, *rules).clients("email", "lifetime_spend").collect()
        assert len(seen) == (63 if hidden else 250)
        assert all((r.email == P.HIDDEN_EMAIL) == hidden for r in seen)
        assert all((r.lifetime_spend is None) == hidden for r in seen)


def test_filters_see_raw_values(spark):
    """A mask on the filtered column must not blind the filter, whatever order the rules come in."""

    def hide_city(df):
        return df.withColumn("city", df.city.substr(1, 1))

    s = star(spark, clients=[client(1), client(2, city="Oslo")])
    mask = P.Rule("clients", ("city",), hide_city, masks=True)
    seen = P.govern(s, mask, P.city_rows("u", ["u"], "Oslo"))
    assert rows(seen.clients("client_id", "city")) == [(2, "O")]


def test_question_runs_on_masked_columns(sample):
    user = "viewer@x.com"
    seen = P.govern(sample, P.mask_lifetime_spend(user, [user]), P.mask_email(user, [user]))
    before, after = C.client_preview(sample).collect(), C.client_preview(seen).collect()
    assert len(before) == len(after) == 10
    assert [r.client_id for r in after] == sorted(r.client_id for r in after)  # order left to the tie-break
    assert {r.email for r in after} == {P.HIDDEN_EMAIL} and "@" in before[0].email
    assert seen.clients("city").columns == ["city"]


def test_date_bounds_still_prune(sample):
    own = P.govern(sample, P.own_rows(sample, "olivia.stern@house.com", DOMAIN, "transactions"))
    plan = own.sales("total_amount", since="2026-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "sale_month#" in "".join(part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
