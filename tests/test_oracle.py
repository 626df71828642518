"""Every registered query against its oracle SQL on the sample tables."""

import os

import pytest

import __spark_entry__ as entry
import permit_oracle
from compare import compare, open_oracle
from permitlake.schemas import TABLES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
# The registry's own; the training-data operators have tests of their own.
QUERIES = {name: entry.queries()[name] for name in entry._queries()}
ORACLES = permit_oracle.oracle_sql()


@pytest.fixture(scope="module")
def oracle_db():
    return open_oracle(FOLDER)


def test_each_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle_db, name):
    assert compare(QUERIES[name](spark, FOLDER), oracle_db, ORACLES[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 262


def test_known_facts(spark):
    """Figures of FIXTURES.md at sf0.01."""
    folder = "/root/testdata/sf0.01"

    def run(name):
        return QUERIES[name](spark, folder)

    statuses = {r.permit_status_desc: r.permits for r in run("permit_status_desc").collect()}
    assert statuses == {"Expired": 336, "Expiring Soon": 172, "Valid": 1847}
    assert run("expiring_permits").count() == 63
    assert run("high_risk_businesses").count() == 310  # 0.30004 is above the bound
    assert run("businesses_without_permit").count() == 354
    actions = {r.action: r["count"] for r in run("audit_changes").groupBy("action").count().collect()}
    assert actions == {"INSERT": 150, "DELETE": 150, "UPDATE": 93}
    tags = {r.action: r["count"] for r in run("upsert_scores").groupBy("action").count().collect()}
    assert (tags["update"], tags["insert"]) == (500, 250)
    assert run("monthly_revenue").first().revenue == 6182151.10


def test_every_rule_kind_meets_every_table_that_has_it(spark):
    kinds = {
        "check_not_null": lambda t: True, "check_domain": lambda t: t.domains,
        "check_range": lambda t: t.ranges, "check_json": lambda t: t.json,
        "check_unique": lambda t: True, "check_foreign_key": lambda t: t.parents,
    }
    sample = ("users", "businesses", "permits", "payments", "inspections", "compliance_scores")
    for name, has in kinds.items():
        found = {r.table_name for r in QUERIES[name](spark, FOLDER).select("table_name").distinct().collect()}
        wanted = {t for t in sample if has(TABLES[t])}
        assert wanted <= found, (name, wanted - found)


REPORTS_IN_ORDER = [
    "businesses_by_owner", "permits_by_business", "payments_by_permit", "business_summary",
    "expiring_permits", "payment_summary", "inspections_by_business", "inspections_by_inspector",
    "inspection_summary", "compliance_scores_filtered", "high_risk_businesses", "recent_activity",
    "table_preview",
]


@pytest.mark.parametrize("name", REPORTS_IN_ORDER)
def test_order_of_reports(spark, oracle_db, name):
    """T1: the rows come in the oracle's sequence. Its ORDER BY ends in a unique id."""
    wanted = oracle_db.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    key = next(c for c in ("payment_id", "inspection_id", "permit_id", "score_id", "log_id", "business_id") if c in names)
    sequence = [row[names.index(key)] for row in wanted.fetchall()]
    assert [row[key] for row in QUERIES[name](spark, FOLDER).collect()] == sequence
