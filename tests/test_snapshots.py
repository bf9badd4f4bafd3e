"""Commits of a written star: broken writes, batches sent again, readers in between, and profiles from partials."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lapel.operators import profile as P
from lapel.operators import revenue as R
from lapel.sources import star as S
from lapel.sources.catalogue import TODAY
from lapel.sources.schema import SCHEMAS
from lapel.sources.snapshots import Snapshots
from lapel.sources.star import MappedStar, StoredStar, append_batch, row_counts, write_star
from tests.conftest import rows

DAY = date(2025, 3, 10)


def sale(k, client, day, amount=10.0, product="A", back=False):
    return (str(k), day, client, 1, 1, product, 1, amount, 0.0, amount, "Card", back)


def facts(spark, *lines):
    return spark.createDataFrame(list(lines), SCHEMAS["transactions"])


@pytest.fixture
def tables(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    products = spark.createDataFrame([("A", "Suits"), ("B", "Shoes"), ("C", None)], "product_id string, category string")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["products"] if f.name not in ("product_id", "category")]
    stores = spark.createDataFrame([(1, "One"), (2, "Two")], "store_id int, store_name string")
    empty["products"] = products.select("*", *rest).select(*SCHEMAS["products"].names)
    other = [F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["stores"] if f.name not in stores.columns]
    empty["stores"] = stores.select("*", *other).select(*SCHEMAS["stores"].names)
    empty["transactions"] = facts(spark, sale(1, 1, DAY), sale(2, 1, DAY + timedelta(40), 5.0, "B"), sale(3, 2, DAY, back=True))
    return empty


def ids(star):
    return sorted(r.transaction_id for r in star.transactions("transaction_id").collect())


def test_a_batch_is_there_once(spark, tables, tmp_path):
    path = f"file://{tmp_path}/star/"
    star = write_star(MappedStar(spark, tables), path)
    more = {"transactions": facts(spark, sale(4, 3, DAY)), "stores": tables["stores"].limit(1)}
    assert ids(star) == ["1", "2", "3"]
    assert append_batch(star, "b1", more) and not append_batch(star, "b1", more)
    assert ids(star) == ["1", "2", "3"]  # a star keeps what it has seen
    now = StoredStar(spark, path=path)
    assert ids(now) == ["1", "2", "3", "4"] and now.stores().count() == 3
    assert Snapshots(spark, path).current().batches == ["b1"]
    # folded into a new base, it is still known
    folded = write_star(now, f"{tmp_path}/star")
    assert ids(folded) == ["1", "2", "3", "4"] and not append_batch(folded, "b1", more)
    assert ids(StoredStar(spark, path=path)) == ["1", "2", "3", "4"]
    plan = now.transactions("total_amount", since=DAY, before=DAY + timedelta(5))._jdf.queryExecution().executedPlan().toString()
    assert "2025-03-01" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_two_writers_of_one_batch(spark, tables, tmp_path):
    """Both have written their data before either commits."""
    star = write_star(MappedStar(spark, tables), str(tmp_path))
    store = Snapshots(spark, str(tmp_path))
    folders = []
    for _ in range(2):
        folder = store.new_folder("transactions")
        S._write_fact(facts(spark, sale(4, 3, DAY)), folder)
        folders.append(folder)
    assert [store.append("b", {"transactions": store.relative(f)}) for f in folders] == [True, False]
    assert ids(StoredStar(spark, path=star.path)) == ["1", "2", "3", "4"]
    assert len(store.sweep()) == 1 and store.sweep() == []
    assert ids(StoredStar(spark, path=star.path)) == ["1", "2", "3", "4"]


@pytest.mark.parametrize("broken", ["transactions", "clients", "commit"])
def test_a_write_that_breaks_off_changes_nothing(spark, tables, tmp_path, monkeypatch, broken):
    path = str(tmp_path)
    write_star(MappedStar(spark, tables), path)
    bad = dict(tables, transactions=facts(spark, sale(9, 9, DAY)), stores=tables["stores"].limit(1))
    if broken == "commit":
        monkeypatch.setattr(Snapshots, "replace", lambda self, *args: 1 / 0)
    else:
        first = SCHEMAS[broken].names[0]
        stop = F.raise_error(F.lit("lost")).cast(SCHEMAS[broken][first].dataType)
        one = tables["stores"].limit(1).select(stop.alias(first), *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[broken].fields[1:]])
        bad[broken] = one
    with pytest.raises(Exception):  # noqa: B017, PT011
        write_star(MappedStar(spark, bad), path)
    monkeypatch.undo()
    assert ids(StoredStar(spark, path=path)) == ["1", "2", "3"] and StoredStar(spark, path=path).stores().count() == 2
    assert broken == "transactions" or Snapshots(spark, path).sweep()
    again = write_star(MappedStar(spark, dict(tables, transactions=facts(spark, sale(9, 9, DAY)))), path)
    assert ids(again) == ["9"]


def test_a_batch_that_breaks_off_can_be_sent_again(spark, tables, tmp_path, monkeypatch):
    star = write_star(MappedStar(spark, tables), str(tmp_path))
    more = {"transactions": facts(spark, sale(4, 3, DAY)), "stores": tables["stores"].limit(1)}
    monkeypatch.setattr(Snapshots, "append", lambda self, batch, folders: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        append_batch(star, "b", more)
    monkeypatch.undo()
    seen = StoredStar(spark, path=star.path)
    assert ids(seen) == ["1", "2", "3"] and seen.stores().count() == 2
    assert append_batch(star, "b", more)
    assert ids(StoredStar(spark, path=star.path)) == ["1", "2", "3", "4"]


def test_readers_see_the_star_they_opened(spark, tables, tmp_path):
    """A whole rewrite while somebody reads: old answers from the old star, new ones from a new."""
    old = write_star(MappedStar(spark, tables), str(tmp_path))
    before = rows(row_counts(old))
    write_star(MappedStar(spark, dict(tables, transactions=facts(spark, *[sale(k, 1, DAY) for k in range(10)]))), str(tmp_path))
    assert rows(row_counts(old)) == before
    assert len(ids(StoredStar(spark, path=str(tmp_path)))) == 10


def test_nothing_to_append_to(spark, tables, tmp_path):
    with pytest.raises(FileNotFoundError):
        Snapshots(spark, str(tmp_path)).append("b", {})
    assert Snapshots(spark, str(tmp_path)).current() is None and Snapshots(spark, str(tmp_path)).sweep() == []


def test_folding_while_somebody_appends(spark, tables, tmp_path, monkeypatch):
    """The batch comes after the star was read and before the new base is there, or while its own commit is under way."""
    path = str(tmp_path)
    write_star(MappedStar(spark, tables), path)
    star = StoredStar(spark, path=path)
    assert len(ids(star)) == 3
    append_batch(star, "late", {"transactions": facts(spark, sale(4, 3, DAY))})
    write_star(star, path)  # of what it has seen
    assert ids(StoredStar(spark, path=path)) == ["1", "2", "3"]
    assert append_batch(star, "late", {"transactions": facts(spark, sale(4, 3, DAY))})
    assert ids(StoredStar(spark, path=path)) == ["1", "2", "3", "4"]
    put = Snapshots._put

    def slow(self, name, content):
        if name.startswith("appends"):
            monkeypatch.setattr(Snapshots, "_put", put)
            write_star(StoredStar(spark, path=path), path)
        return put(self, name, content)

    monkeypatch.setattr(Snapshots, "_put", slow)
    assert append_batch(star, "later", {"transactions": facts(spark, sale(5, 3, DAY))})
    assert ids(StoredStar(spark, path=path)) == ["1", "2", "3", "4", "5"]
    old = StoredStar(spark, path=path)
    assert len(ids(old)) == 5
    write_star(StoredStar(spark, path=path), path)
    with pytest.raises(FileExistsError):
        write_star(old, path)


# ---- partial profiles ----


def answers(star):
    return sorted(rows(P.client_profile(star))), sorted(rows(P.segment_clients(star, TODAY)), key=repr)


def test_profiles_from_partials_equal_those_from_scratch(spark, tables, tmp_path):
    """Late rows of old months and of days that are there already, returns, clients that were unknown, ties of categories."""
    first = facts(
        spark, sale(1, 1, DAY), sale(2, 1, DAY + timedelta(400), 7.5, "B"), sale(3, 2, DAY, back=True), sale(4, None, DAY), sale(5, 4, DAY, None, "C")
    )
    batches = [
        facts(spark, sale(6, 1, DAY - timedelta(900)), sale(7, 1, DAY + timedelta(400), 1e13, "B"), sale(8, 2, DAY, 3.0001, "unknown")),
        facts(spark, sale(9, 1, DAY + timedelta(390), back=True), sale(10, 1, DAY + timedelta(395), 2.0, "A"), sale(11, 4, DAY + timedelta(1), 1.0, "B")),
        facts(spark),
        facts(spark, *[sale(20 + k, 5, DAY + timedelta(k % 3), 0.1, "AB"[k % 2]) for k in range(40)]),
    ]
    star = write_star(MappedStar(spark, dict(tables, transactions=first)), str(tmp_path), parts=P.partial_profiles)
    everything = first
    for k, batch in enumerate(batches):
        for _ in range(2):
            append_batch(star, f"batch {k}", {"transactions": batch}, P.partial_profiles)
        everything = everything.unionAll(batch)
        if k in (1, 2):
            continue
        now = StoredStar(spark, path=str(tmp_path))
        plain = MappedStar(spark, dict(tables, transactions=everything))
        assert now.profile_parts() is not None and plain.profile_parts() is None
        assert answers(now) == answers(plain)
        both = P.profiles(now, category=True, gap=True)
        same = P.profiles(plain, category=True, gap=True)
        assert both.columns == same.columns and sorted(rows(both), key=repr) == sorted(rows(same), key=repr)
    plan = P.client_profile(now)._jdf.queryExecution().executedPlan().toString()
    assert "data/transactions" not in plan and "SortAggregate" not in plan
    with pytest.raises(ValueError, match="partial profiles"):
        append_batch(star, "more", {"transactions": first})


def test_an_append_touches_its_own_months_only(spark, tables, tmp_path):
    star = write_star(MappedStar(spark, tables), str(tmp_path), parts=P.partial_profiles)
    append_batch(star, "b", {"transactions": facts(spark, sale(9, 1, date(2024, 1, 5)), sale(10, 1, date(2024, 1, 6)))}, P.partial_profiles)
    folders = StoredStar(spark, path=star.path).folders()[S.PARTS]
    months = [sorted(p.name for p in (tmp_path / f.split(f"{tmp_path}/")[1]).glob("sale_month=*")) for f in folders]
    assert months == [["sale_month=2025-03-01", "sale_month=2025-04-01"], ["sale_month=2024-01-01"]]


def test_sample_star(spark, sample, tmp_path):
    star = write_star(sample, str(tmp_path), parts=P.partial_profiles)
    assert answers(star) == answers(sample)
    assert sorted(rows(R.revenue_by_store_12m(star, TODAY))) == sorted(rows(R.revenue_by_store_12m(sample, TODAY)))


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def test_partial_profiles_shuffle_the_sales_once(spark, tables):
    """First, last and last but one day of a month come out of one pass: first and last days of months, days that come twice, one day, none."""
    days = [date(2024, 1, 31), date(2024, 1, 1), date(2024, 1, 31), date(2024, 2, 29), date(2024, 2, 28), date(2024, 2, 2), None]
    sales = [sale(k, 1, d) for k, d in enumerate(days)] + [sale(50, 2, DAY), sale(51, 2, DAY, None), sale(52, 2, DAY, back=True)]
    parts = P.partial_profiles(MappedStar(spark, dict(tables, transactions=facts(spark, *sales))))
    assert [s for s in shuffles(parts) if "client_id" in s] == ["sale_month, client_id, category, 4"]
    assert "Window" not in parts._jdf.queryExecution().executedPlan().toString()
    got = {(r.client_id, r.sale_month): (r.n, r.valued, r.first_day, r.last_day, r.prior_day) for r in parts.collect()}
    assert got == {
        (1, date(2024, 1, 1)): (3, 3, date(2024, 1, 1), date(2024, 1, 31), date(2024, 1, 1)),
        (1, date(2024, 2, 1)): (3, 3, date(2024, 2, 2), date(2024, 2, 29), date(2024, 2, 28)),
        (1, None): (1, 1, None, None, None),
        (2, date(2025, 3, 1)): (2, 1, DAY, DAY, None),
    }


def test_profiles_from_partials_shuffle_them_once(spark, tables, tmp_path):
    star = write_star(MappedStar(spark, tables), str(tmp_path), parts=P.partial_profiles)
    assert [s for s in shuffles(P.client_profile(star)) if "client_id" in s] == ["client_id, 4"]
    assert [s for s in shuffles(P.segment_clients(star, TODAY)) if "client_id" in s] == ["client_id, 4"]


def test_days_of_a_profile_are_shuffled_as_one_number(spark, tables):
    """No minimum and maximum of a day beside it, neither to the sums by day nor to the window over them."""
    star = MappedStar(spark, tables)
    sales = star.sales("client_id", "transaction_date", "total_amount", "product_id")
    plan = P.profile(sales, star.products("product_id", "category"), gap=True)._jdf.queryExecution().executedPlan().toString()
    assert "min(transaction_date" not in plan and "max(transaction_date" not in plan
