"""Edges of the reports on small hand-made tables."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frames import NOW, business, registry, user
from permitlake.functions.rules import permit_fee, status_description
from permitlake.plans import (
    businesses, compliance, dashboard, inspections, monthly, payments, permits, search_index,
    users,
)
from permitlake.registry import Registry
from permitlake.schemas import TABLES
from permitlake.sources import parquet

AS_OF = dt.date(2024, 6, 15)


def permit(i, business_id, expiry=None, **over):
    row = dict(
        permit_id=i, business_id=business_id, permit_year=2024, fee_amount=Decimal("100.00"),
        status="issued", issue_date=dt.date(2024, 1, 15), expiry_date=expiry,
        penalty_amount=Decimal("0.00"),
    )
    return {**row, **over}


def payment(i, permit_id, amount, status="success", at=NOW, **over):
    row = dict(
        payment_id=i, permit_id=permit_id, amount=Decimal(amount), payment_method="cash",
        status=status, paid_at=at,
    )
    return {**row, **over}


def in_days(n):
    return AS_OF + dt.timedelta(days=n)


def test_expiry_edges_differ_between_the_rules(spark):
    """Day 30 is in the expiring list, but not 'Expiring Soon'; a missing expiry is
    'Valid' and yet expired."""
    days = {1: -1, 2: 0, 3: 29, 4: 30, 5: 31}
    rows = [permit(i, i, in_days(n)) for i, n in days.items()] + [permit(6, 6)]
    reg = registry(spark, permits=rows, businesses=[business(i) for i in range(1, 8)])

    summary = businesses.business_summary(reg, as_of=AS_OF).collect()
    assert {r.business_id: r.permit_status_desc for r in summary} == {
        1: "Expired", 2: "Expiring Soon", 3: "Expiring Soon", 4: "Valid", 5: "Valid",
        6: "Valid", 7: "Valid",
    }
    listed = permits.expiring_permits(reg, as_of=AS_OF).collect()
    assert [r.permit_id for r in listed] == [2, 3, 4]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 6, 99)], "permit_id bigint")
    expired = permits.permits_expired(reg, ids, as_of=AS_OF).collect()
    assert {r.permit_id: r.is_expired for r in expired} == {1: True, 2: False, 6: True, 99: True}
    stats = businesses.business_statistics(reg, as_of=AS_OF).first()
    assert (stats.total_businesses, stats.expired_permits, stats.expiring_soon) == (7, 1, 2)


def test_expiring_list_wants_issued_permits(spark):
    reg = registry(
        spark,
        businesses=[business(1)],
        permits=[permit(1, 1, in_days(3)), permit(2, 1, in_days(3), status="cancelled")],
    )
    assert [r.permit_id for r in permits.expiring_permits(reg, as_of=AS_OF).collect()] == [1]
    assert permits.expiring_permits(reg, as_of=AS_OF, days_ahead=2).count() == 0


def test_summary_fans_out_and_keeps_businesses_without_permit(spark):
    rows = [permit(i, 1, in_days(100)) for i in (1, 2, 3)]
    rows.append(permit(4, 2, in_days(100), permit_year=2023))
    rows.append(permit(5, 3, in_days(100)))
    reg = registry(
        spark,
        businesses=[business(1), business(2, size="Large"), business(3, status="closed")],
        permits=rows,
        compliance_scores=[
            dict(score_id=1, business_id=1, score=Decimal("0.5"), model_version="v"),
            dict(score_id=2, business_id=1, score=Decimal("0.6"), model_version="v"),
        ],
    )
    summary = businesses.business_summary(reg, as_of=AS_OF).collect()
    assert [(r.business_id, r.permit_id) for r in summary] == [(1, 1), (1, 2), (1, 3), (2, None)]
    both = businesses.business_permit_summary(reg, as_of=AS_OF).collect()
    assert len(both) == 7
    stats = businesses.business_statistics(reg, as_of=AS_OF).first()
    assert (stats.total_businesses, stats.distinct_businesses) == (4, 2)
    assert (stats.small_businesses, stats.large_businesses, stats.active_permits) == (3, 1, 3)
    one = businesses.business_summary(reg, as_of=AS_OF, business_id=2).collect()
    assert [r.business_name for r in one] == ["Shop 2"]


shops = st.lists(st.tuples(st.sampled_from(["Small", "Large"]), st.booleans()), max_size=5)
held = st.lists(
    st.tuples(
        st.integers(0, 6), st.sampled_from([2023, 2024]), st.sampled_from(["issued", "expired"]),
        st.one_of(st.none(), st.integers(-40, 40)),
    ),
    max_size=12,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(shops=shops, held=held)
def test_statistics_and_summary_equal_a_nested_loop(spark, shops, held):
    reg = registry(
        spark,
        businesses=[business(i, size=size, status="active" if on else "closed")
                    for i, (size, on) in enumerate(shops)],
        permits=[permit(i, b, None if n is None else in_days(n), permit_year=y, status=s)
                 for i, (b, y, s, n) in enumerate(held)],
    )
    pairs = []
    for b, (size, on) in enumerate(shops):
        own = [(i, s, n) for i, (of, y, s, n) in enumerate(held) if of == b and y == 2024]
        pairs += [(b, size, *p) for p in own or [(None, None, None)]] if on else []
    stats = businesses.business_statistics(reg, as_of=AS_OF).first().asDict()
    assert stats == {
        "total_businesses": len(pairs),
        "active_permits": sum(p[3] == "issued" for p in pairs),
        "expired_permits": sum(p[4] is not None and p[4] < 0 for p in pairs),
        "expiring_soon": sum(p[4] is not None and 0 <= p[4] < 30 for p in pairs),
        "small_businesses": sum(p[1] == "Small" for p in pairs),
        "medium_businesses": 0,
        "large_businesses": sum(p[1] == "Large" for p in pairs),
        "distinct_businesses": sum(on for _, on in shops),
    }
    summary = businesses.business_summary(reg, as_of=AS_OF).collect()
    assert [(r.business_id, r.permit_id) for r in summary] == [(p[0], p[2]) for p in pairs]


def test_empty_tables(spark):
    reg = registry(spark)
    stats = businesses.business_statistics(reg, as_of=AS_OF).first()
    assert stats.total_businesses == 0 and stats.active_permits == 0
    rate = dashboard.compliance_rate(reg, as_of=AS_OF).first()
    assert (rate.compliance_rate, rate.band) == (None, "gray")
    quick = {r.metric: r.value for r in dashboard.quick_stats(reg, as_of=AS_OF).collect()}
    assert quick["Payment Success Rate"] == "0%" and quick["Total Businesses"] == "0"
    paid = payments.payment_statistics(reg).first()
    assert paid.total_payments == 0 and paid.total_amount_collected == 0
    assert dashboard.recent_activity(reg).count() == 0
    assert payments.revenue_trend(reg, as_of=AS_OF).count() == 31
    assert businesses.business_permit_summary(reg, as_of=AS_OF).count() == 0


def test_whole_success_rate_has_no_decimals(spark):
    rows = [payment(1, 1, "10"), payment(2, 1, "10", status="failed")]
    reg = registry(spark, payments=rows)
    quick = {r.metric: r.value for r in dashboard.quick_stats(reg, as_of=AS_OF).collect()}
    assert quick["Payment Success Rate"] == "50%"


@pytest.mark.parametrize(("active", "band"), [(8, "green"), (6, "yellow"), (5, "red")])
def test_compliance_bands(spark, active, band):
    rows = [permit(i, i, in_days(100), status="issued" if i <= active else "cancelled")
            for i in range(1, 11)]
    reg = registry(spark, businesses=[business(i) for i in range(1, 11)], permits=rows)
    rate = dashboard.compliance_rate(reg, as_of=AS_OF).first()
    assert (rate.compliance_rate, rate.band) == (active * 10.0, band)


def test_search_escapes_wildcards_unless_raw(spark):
    names = {1: "100% Fresh", 2: "100 Fresh", 3: "a_b", 4: "axb", 5: "back\\slash"}
    reg = registry(spark, businesses=[business(i, name=n) for i, n in names.items()])

    def found(term, **how):
        rows = businesses.search_businesses(reg, as_of=AS_OF, term=term, **how).collect()
        return sorted(r.business_id for r in rows)

    assert found("100% f") == [1]
    assert found("0%f") == [] and found("0%f", raw=True) == [1, 2]
    assert found("a_b") == [3] and found("A_B", raw=True) == [3, 4]
    assert found("K\\S") == [5]
    assert found("a000000004z") == [4]


def test_search_filters_fold(spark):
    reg = registry(
        spark,
        businesses=[
            business(1), business(2, ward="South"), business(3, category="Services"),
            business(4, size="Large"), business(5, status="closed"),
        ],
    )

    def found(**how):
        return {r.business_id for r in businesses.search_businesses(reg, as_of=AS_OF, **how).collect()}

    assert found() == {1, 2, 3, 4}
    assert found(ward="South") == {2} and found(size="Large") == {4}
    assert found(category="Retail", ward="North", size="Small") == {1}


def test_single_key_list_and_frame_lookups_agree(spark):
    reg = registry(
        spark,
        users=[user(1), user(2)],
        businesses=[business(1), business(2, owner_id=2), business(3), business(4, owner_id=None)],
    )
    keys = spark.createDataFrame([(1,), (1,), (None,)], "x bigint")
    for wanted in (1, [1], keys):
        rows = businesses.businesses_by_owner(reg, wanted).collect()
        assert [r.business_id for r in rows] == [3, 1]
    assert [r.user_id for r in users.users_by_email(reg, "u2@x.example").collect()] == [2]
    assert [r.user_id for r in users.users_by_id(reg, [1, 7]).collect()] == [1]
    assert businesses.businesses_by_pins(reg, ["A000000002Z"]).first().business_id == 2


def test_nulls_sort_as_in_the_reference(spark):
    """Last when ascending, first when descending."""
    reg = registry(
        spark,
        businesses=[business(1, created_at=None), business(2), business(3)],
        payments=[payment(1, 1, "1", at=None), payment(2, 1, "1")],
        permits=[permit(1, 1, in_days(2)), permit(2, 1, in_days(1))],
    )
    rows = businesses.businesses_by_owner(reg, 1).collect()
    assert [r.business_id for r in rows] == [1, 3, 2]
    assert [r.payment_id for r in payments.payments_by_permit(reg, 1).collect()] == [1, 2]


def test_balances(spark):
    reg = registry(
        spark,
        businesses=[business(1)],
        permits=[permit(1, 1), permit(2, 1)],
        payments=[
            payment(1, 1, "60.00"), payment(2, 1, "30.50"), payment(3, 1, "5.00", "failed"),
        ],
    )
    each = payments.outstanding_by_payment(reg).collect()
    assert {r.payment_id: r.outstanding_amount for r in each} == {
        1: Decimal("40.00"), 2: Decimal("69.50"), 3: Decimal("100.00"),
    }
    whole = payments.outstanding_by_permit(reg).collect()
    assert {r.permit_id: r.outstanding_amount for r in whole} == {
        1: Decimal("9.50"), 2: Decimal("100.00"),
    }


def test_outstanding_by_payment_equals_the_grouped_definition(spark):
    reg = registry(
        spark,
        businesses=[business(1), business(2)],
        permits=[permit(1, 1), permit(2, 2)],
        payments=[
            payment(i, 1 + i % 2, f"{i}.25", ("success", "failed", "pending")[i % 3])
            for i in range(20)
        ],
    )
    summary = payments.payment_summary(reg, ordered=False)
    paid = F.sum(F.when(F.col("payment_status") == "success", F.col("amount")).otherwise(0))
    grouped = summary.groupBy(*summary.columns).agg(paid.alias("paid")).select(
        "payment_id", (F.col("fee_amount") - F.col("paid")).alias("outstanding_amount")
    )
    each = payments.outstanding_by_payment(reg).select("payment_id", "outstanding_amount")
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, each.collect()))


def test_payment_range_bounds(spark):
    """Both bounds count, a missing one is open, and a date ends at its midnight."""
    first, last = dt.date(2024, 6, 1), dt.date(2024, 6, 15)
    times = [
        dt.datetime(2024, 5, 31, 23, 59, 59), dt.datetime(2024, 6, 1),
        dt.datetime(2024, 6, 15), dt.datetime(2024, 6, 15, 0, 0, 1), None,
    ]
    rows = [payment(i, 1, f"{10 ** i}", at=at) for i, at in enumerate(times)]
    reg = registry(spark, payments=rows)

    def total(**bounds):
        return payments.payment_statistics(reg, **bounds).first().total_amount_collected

    assert total() == 11111
    assert total(start=first, end=last) == 110
    assert total(start=first) == 1110 and total(end=last) == 111
    month = payments.monthly_revenue(reg, as_of=last).first()
    assert (month.revenue, month.display) == (Decimal("110"), "KES 110.00")


def test_revenue_trend(spark):
    at = dt.datetime(2024, 6, 13, 23, 59)
    rows = [
        payment(1, 1, "5", at=at), payment(2, 1, "7", at=at), payment(3, 1, "9", "failed", at=at),
        payment(4, 1, "1", at=dt.datetime(2024, 6, 15, 23, 0)),
        payment(5, 1, "100", at=dt.datetime(2024, 6, 11, 23, 0)),
        payment(6, 1, "100", at=dt.datetime(2024, 6, 16)),
    ]
    trend = payments.revenue_trend(registry(spark, payments=rows), as_of=AS_OF, days=3).collect()
    figures = [(r.day.day, int(r.daily_revenue), int(r.cumulative_revenue)) for r in sorted(trend)]
    assert figures == [(12, 0, 0), (13, 12, 12), (14, 0, 12), (15, 1, 13)]


def test_days_since_inspection_are_whole_periods(spark):
    """Whole 24-hour periods, not calendar days."""
    hours = {1: 0, 2: 23, 3: 24, 4: 47, 5: 24 * 400, 6: -23, 7: -25}
    rows = [
        dict(inspection_id=i, business_id=1, inspector_id=1, status="visited",
             inspected_at=NOW - dt.timedelta(hours=h))
        for i, h in hours.items()
    ]
    reg = registry(spark, inspections=rows, businesses=[business(1)], users=[user(1)])
    found = inspections.inspection_summary(reg, now=NOW).collect()
    assert {r.inspection_id: r.days_since_inspection for r in found} == {
        1: 0, 2: 0, 3: 1, 4: 1, 5: 400, 6: 0, 7: -1,
    }
    assert [r.inspection_id for r in found] == [7, 6, 1, 2, 3, 4, 5]


def test_inspections_by_inspector_range(spark):
    rows = [
        dict(inspection_id=i, business_id=1, inspector_id=1 + i % 2, status="visited",
             inspected_at=dt.datetime(2024, 6, i))
        for i in range(1, 9)
    ]
    reg = registry(spark, inspections=rows, businesses=[business(1)], users=[user(1), user(2)])
    of = inspections.inspections_by_inspector
    low, high = dt.date(2024, 6, 4), dt.datetime(2024, 6, 6)
    assert [r.inspection_id for r in of(reg, 1, start=low, end=high).collect()] == [6, 4]
    assert [r.inspection_id for r in of(reg, 1, start=low).collect()] == [8, 6, 4]
    assert [r.inspector_name for r in of(reg, 2, end=low).collect()] == ["User 2"] * 2
    assert inspections.inspections_by_business(reg, 1).count() == 8


def test_score_filters_count_their_bounds(spark):
    rows = [
        dict(score_id=i, business_id=1, score=Decimal(i) / 10, model_version="v",
             cluster_label="low" if i > 5 else "high")
        for i in range(11)
    ]
    reg = registry(spark, compliance_scores=rows, businesses=[business(1)])

    def found(**how):
        return [r.score_id for r in compliance.compliance_scores(reg, **how).collect()]

    assert found() == list(range(10, -1, -1))
    assert found(min_score=Decimal("0.3"), max_score=Decimal("0.6")) == [6, 5, 4, 3]
    assert found(min_score=Decimal("0.3"), cluster_label="high") == [5, 4, 3]
    risky = compliance.high_risk_businesses(reg).collect()
    assert [r.score_id for r in risky] == [0, 1, 2, 3]


def test_fees_of_other_and_missing_sizes(spark):
    rows = [
        ("Small", "Retail", 5000), ("Small", "Services", 7500), ("Small", None, 10000),
        ("Medium", "Retail", 15000), ("Medium", "Services", 20000), ("Medium", "x", 25000),
        ("Large", "Manufacturing", 100000), ("Large", "Retail", 50000),
        ("Huge", "Retail", 5000), (None, "Services", 5000),
    ]
    frame = spark.createDataFrame(rows, "size string, category string, want int")
    fee = permit_fee(F.col("size"), F.col("category"))
    assert all(r.fee == r.want for r in frame.withColumn("fee", fee).collect())


def test_status_of_null_expiry(spark):
    label = status_description(F.lit(None).cast("date"), AS_OF)
    assert spark.range(1).select(label.alias("x")).first().x == "Valid"


def test_recent_activity_names_users(spark):
    logs = [
        dict(log_id=i, user_id=who, action="UPDATE", target_table="permits", target_id=i,
             timestamp=dt.datetime(2024, 6, 1, 9, i))
        for i, who in enumerate([1, 2, 0, None, 2, 1, 1])
    ]
    reg = registry(spark, audit_logs=logs, users=[user(1), user(2)])
    found = dashboard.recent_activity(reg).collect()
    assert [(r.time, r.user) for r in found] == [
        ("09:06", "User 1"), ("09:05", "User 1"), ("09:04", "User 2"), ("09:03", "System"),
        ("09:02", "System"),
    ]


def test_preview_and_console_guards(spark):
    reg = registry(spark, users=[user(i) for i in range(150, 0, -1)])
    shown = dashboard.table_preview(reg, "users").collect()
    assert [r.user_id for r in shown] == list(range(1, 101))
    with pytest.raises(ValueError):
        dashboard.table_preview(reg, "api_keys")
    count = dashboard.sql_select(reg, "  select COUNT(*) as total_users FROM users;")
    assert count.first().total_users == 150
    for text in ("", "  ", "DROP TABLE users", "WITH x AS (SELECT 1) SELECT * FROM x"):
        with pytest.raises(ValueError):
            dashboard.sql_select(reg, text)
    with pytest.raises(ValueError):
        reg.table("nothing")
    counts = {r.table_name: r.row_count for r in dashboard.table_counts(reg).collect()}
    assert counts == {"users": 150, "businesses": 0, "permits": 0}


# --- postings, monthly parts, the newest months -------------------------------------------

NAMES = st.one_of(st.none(), st.text("abAB%_\\ é\u0130", max_size=7))


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(NAMES, NAMES), max_size=9), st.text("abAB%_ é\u0130", max_size=5), st.booleans())
def test_search_by_postings_finds_what_a_scan_finds(spark, texts, term, raw):
    shops = [business(i, name=n, kra_pin=p) for i, (n, p) in enumerate(texts)]
    reg = registry(spark, businesses=shops)
    postings = search_index.build_postings(reg.table("businesses"))
    found, scanned = (
        sorted(r.business_id for r in businesses.search_businesses(
            reg, as_of=AS_OF, term=term, raw=raw, ordered=False, postings=p
        ).collect())
        for p in (postings, None)
    )
    assert found == scanned


def test_stored_postings_are_read_by_trigram(spark, tmp_path):
    shops = [business(i, name=f"Shop {i:05d} of everyone") for i in range(3000)]
    reg = registry(spark, businesses=shops)
    search_index.write_postings(reg.table("businesses"), f"{tmp_path}/postings", partitions=60)
    postings = search_index.read_postings(spark, f"{tmp_path}/postings")
    rows = businesses.search_businesses(reg, as_of=AS_OF, term="02345 OF", postings=postings)
    assert [r.business_id for r in rows.collect()] == [2345]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan or "gram IN" in plan or "PushedFilters: [In" in plan
    # The list of a trigram that every business has lies in several files.
    files = postings.filter("gram = 'eve'").select(F.input_file_name()).distinct().count()
    assert files > 1


times = st.one_of(st.none(), st.datetimes(dt.datetime(2024, 1, 1), dt.datetime(2024, 4, 30)))
money = st.one_of(st.none(), st.decimals("0", "999.99", places=2))
a_payment = st.tuples(
    times, st.sampled_from(["success", "pending", "failed", None]),
    st.sampled_from(["mpesa", "cash", "bank", None]), money,
)
an_inspection = st.tuples(
    times, st.sampled_from(["visited", "not_found", "noncompliant", None]),
    st.sampled_from([None, 1, 2, 0, -1, 32768, 32769, 10**12, -40000]),
)


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(a_payment, max_size=12), st.lists(an_inspection, max_size=12))
def test_monthly_parts_add_up(spark, paid, seen):
    reg = registry(
        spark,
        payments=[
            dict(payment_id=i, permit_id=1, paid_at=t, status=s, payment_method=m, amount=a)
            for i, (t, s, m, a) in enumerate(paid)
        ],
        inspections=[
            dict(inspection_id=i, business_id=1, inspected_at=t, status=s, inspector_id=n)
            for i, (t, s, n) in enumerate(seen)
        ],
    )
    parts = monthly.payment_parts(reg.table("payments"))
    assert monthly.payment_statistics(parts).collect() == payments.payment_statistics(reg).collect()
    parts = monthly.inspection_parts(reg.table("inspections"))
    merged, direct = monthly.inspection_statistics(parts), inspections.inspection_statistics(reg)
    assert merged.columns == direct.columns and merged.collect() == direct.collect()


def test_only_changed_months_are_computed_again(spark):
    def paid(i, month, amount):
        return dict(
            payment_id=i, permit_id=1, status="success", payment_method="cash",
            amount=Decimal(amount), paid_at=month and dt.datetime(2024, month, 3),
        )

    before = registry(spark, payments=[paid(1, 1, 5), paid(2, 2, 7), paid(3, None, 1)])
    parts = monthly.payment_parts(before.table("payments"))
    after = registry(spark, payments=[paid(1, 1, 50), paid(4, 2, 70), paid(5, None, 100), paid(6, 3, 9)])

    def total(months):
        rows = monthly.refreshed(parts, after, "payments", months)
        return monthly.payment_statistics(rows).first()["total_amount_collected"]

    assert total([]) == 13 and total([dt.date(2024, 2, 1)]) == 76
    assert total([None]) == 112 and total([None, dt.date(2024, 1, 1), dt.date(2024, 2, 1)]) == 220
    assert total([dt.date(2024, 3, 1)]) == 22


def test_recent_activity_reads_the_newest_months_only(spark, tmp_path):
    """Files of older months may be broken: they are not opened."""
    def entry_of(i, month):
        when = month and dt.datetime(2024, month, 1 + i % 20)
        return dict(log_id=i, user_id=1, action="UPDATE", target_table="permits", target_id=i, timestamp=when)

    logs = [entry_of(i, month) for month, ids in ((1, range(4)), (2, range(4, 7)), (3, range(7, 9))) for i in ids]
    reg = registry(spark, users=[user(1)], audit_logs=logs)
    for name in TABLES:
        parquet.write_table(reg.table(name), f"{tmp_path}/{name}", name)
    stored = parquet.open_registry(spark, str(tmp_path))
    assert stored.months("audit_logs") == [dt.date(2024, m, 1) for m in (3, 2, 1)]
    expected = dashboard.recent_activity(reg, count=5).collect()
    for file in tmp_path.glob("audit_logs/*=2024-01-01/*.parquet"):
        file.write_bytes(b"broken")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert dashboard.recent_activity(stored, count=5).collect() == expected
    with pytest.raises((PySparkException, Py4JJavaError), match="broken|not a Parquet|read"):
        dashboard.recent_activity(stored, count=8).collect()
    late = registry(spark, users=[user(1)], audit_logs=[*logs, entry_of(99, None)])
    parquet.write_table(late.table("audit_logs"), f"{tmp_path}/late", "audit_logs")
    month = spark.read.schema(TABLES["audit_logs"].schema.add("stored_month", "date")).parquet(f"{tmp_path}/late")
    dated = Registry(spark, {"audit_logs": late.table("audit_logs"), "users": late.table("users")}, {"audit_logs": month})
    assert dashboard.recent_activity(dated, count=3).collect() == dashboard.recent_activity(late, count=3).collect()
    assert dated.months("audit_logs")[0] is None
