"""Audit rows and table, and the resume plan."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from conftest import job, schedule, settings

from spendguard import schemas as S
from spendguard.plans import audit, resume_plan, run_resume

NOW = dt.datetime(2026, 4, 20, 9, 30)


def _plan(spark, rows):
    return spark.createDataFrame(rows, "step int, resource_type string, resource_id string, resource_name string")


def _table():
    return f"sg_test_{uuid.uuid4().hex[:8]}.paused_jobs"


def test_audit_rows_ids_are_text_and_stamped(spark):
    jobs = spark.createDataFrame([(1, "JOB", 12345, "My Job")],
                                 "step int, resource_type string, resource_id bigint, resource_name string")
    clusters = _plan(spark, [(3, "CLUSTER", "0410-abc123", "C")])
    rows = audit.audit_rows(jobs, NOW).unionByName(audit.audit_rows(clusters, NOW)).collect()
    assert [r.resource_id for r in rows] == ["12345", "0410-abc123"]
    assert {(r.action, r.acted_by, r.month, r.timestamp) for r in rows} == {("STOPPED", "budget_enforcer", "2026-04", NOW)}


def test_only_succeeded_actions_are_audited(spark):
    plan = _plan(spark, [(1, "JOB", "1", "a"), (3, "CLUSTER", "c1", "b"), (5, "APP", "x", "x"), (5, "APP", "x", "x")])
    outcomes = spark.createDataFrame([("JOB", "1", False), ("CLUSTER", "c1", True), ("APP", "x", True),
                                      ("APP", "x", True)], "resource_type string, resource_id string, ok boolean")
    got = sorted(tuple(r) for r in audit.succeeded(plan, outcomes).collect())
    assert got == [(3, "CLUSTER", "c1", "b"), (5, "APP", "x", "x"), (5, "APP", "x", "x")]


def test_audit_table_create_append_reorder_truncate(spark):
    table = _table()
    rows = audit.audit_rows(_plan(spark, [(1, "JOB", "1", None), (4, "WAREHOUSE", "w", None)]), NOW)
    assert audit.append(rows, table) == 2                              # all names NULL: explicit schema
    assert audit.append(rows.select(*reversed(rows.columns)), table) == 2  # matched by name
    back = audit.read_audit(spark, table)
    assert back.columns == list(S.AUDIT_COLUMNS)
    assert sorted((r.resource_type, r.resource_id) for r in back.collect()) == [
        ("JOB", "1"), ("JOB", "1"), ("WAREHOUSE", "w"), ("WAREHOUSE", "w")]
    assert audit.append(rows.limit(0), table) == 0                     # nothing to write
    audit.clear(spark, table)
    assert audit.read_audit(spark, table).count() == 0
    audit.ensure_table(spark, table)                                   # idempotent


def test_record_actions(spark):
    table = _table()
    plan = _plan(spark, [(1, "JOB", "1", "a"), (3, "CLUSTER", "c1", "b")])
    outcomes = spark.createDataFrame([("JOB", "1", True)], "resource_type string, resource_id string, ok boolean")
    assert audit.record_actions(plan, table, outcomes=outcomes, now=NOW) == 1
    assert [r.resource_id for r in audit.read_audit(spark, table).collect()] == ["1"]


def test_previous_month_filter(spark):
    rows = spark.createDataFrame([("JOB", "STOPPED", "1", "a", NOW, "budget_enforcer", "2026-03"),
                                  ("JOB", "STOPPED", "2", "b", NOW, "budget_enforcer", "2026-04")], S.AUDIT)
    got = audit.filter_month(rows, month_filter="previous", as_of=dt.date(2026, 4, 6)).collect()
    assert [r.resource_id for r in got] == ["1"]
    assert audit.filter_month(rows).count() == 2


def _audit(spark, rows):
    return spark.createDataFrame(
        [(t, "STOPPED", i, None, NOW, "budget_enforcer", m) for t, i, m in rows], S.AUDIT)


def _jobs(spark):
    return spark.createDataFrame([
        (200, settings("sched", schedule=schedule("0 0 8 * * ?", "UTC", "PAUSED"))),
        (201, settings("cont", continuous=("PAUSED",))),
        (202, settings("trig", trigger=("fa", "tu", "PAUSED"))),
        (203, settings("manual")),
        (204, settings("placeholder", schedule=schedule(S.PLACEHOLDER_CRON, "UTC", "PAUSED"))),
        (205, None),
        (12345, settings("x", schedule=schedule())),
    ], S.JOBS)


def test_resume_plan_actions(spark):
    a = _audit(spark, [("JOB", "200", "2026-04"), ("JOB", "201", "2026-03"), ("JOB", "202", "2026-04"),
                       ("JOB", "203", "2026-04"), ("JOB", "204", "2026-04"), ("JOB", "205", "2026-04"),
                       ("JOB", "999", "2026-04"), ("JOB", "12.7", "2026-04"), ("JOB", " 12345 ", "2026-04"),
                       ("CLUSTER", "c1", "2026-03"), ("WAREHOUSE", "w1", "2026-04"), ("APP", "a", "2026-04"),
                       ("APP", "a", "2026-04"), ("OTHER", "z", "2026-04"), (None, "z", "2026-04")])
    rows = resume_plan(a, _jobs(spark)).collect()
    got = sorted(((r.resource_type or ""), r.resource_id, r.resume_action) for r in rows)
    assert got == sorted([
        ("JOB", "200", "UNPAUSE"), ("JOB", "201", "UNPAUSE"), ("JOB", "202", "UNPAUSE"),
        ("JOB", "203", "REMOVE_SCHEDULE"), ("JOB", "204", "REMOVE_SCHEDULE"), ("JOB", "205", "FAILED"),
        ("JOB", "999", "FAILED"), ("JOB", "12.7", "FAILED"), ("JOB", " 12345 ", "UNPAUSE"),
        ("CLUSTER", "c1", "START"), ("WAREHOUSE", "w1", "START"), ("APP", "a", "START"), ("APP", "a", "START"),
        ("OTHER", "z", "UNKNOWN"), ("", "z", "UNKNOWN")])
    by_id = {r.resource_id: r for r in rows}
    assert tuple(by_id["200"].new_settings.schedule) == ("0 0 8 * * ?", "UTC", "UNPAUSED")
    assert tuple(by_id["201"].new_settings.continuous) == ("UNPAUSED",)
    assert tuple(by_id["202"].new_settings.trigger) == ("fa", "tu", "UNPAUSED")
    assert by_id["203"].new_settings.schedule is None
    assert by_id[" 12345 "].job_id == 12345 and by_id["12.7"].job_id is None


def test_resume_placeholder_unpause_mode(spark):
    a = _audit(spark, [("JOB", "204", "2026-04")])
    row = resume_plan(a, _jobs(spark), placeholder="unpause").first()
    assert row.resume_action == "UNPAUSE"
    assert tuple(row.new_settings.schedule) == (S.PLACEHOLDER_CRON, "UTC", "UNPAUSED")


def test_resume_plan_shuffle_join_when_inventory_large(spark):
    a = _audit(spark, [("JOB", "200", "2026-04"), ("JOB", "999", "2026-04"), ("APP", "a", "2026-04")])
    got = sorted((r.resource_id, r.resume_action) for r in resume_plan(a, _jobs(spark), max_broadcast_rows=0).collect())
    assert got == [("200", "UNPAUSE"), ("999", "FAILED"), ("a", "START")]


def test_user_paused_job_stays_paused_through_stop_and_resume(spark, jobs_df):
    from spendguard.plans import job_stop_plan, stop_plan
    jobs = jobs_df([job(200), job(201, "PAUSED")])
    assert [r.job_id for r in job_stop_plan(jobs).collect()] == [200]
    plan = stop_plan(jobs=jobs, clusters=spark.createDataFrame([], S.CLUSTERS),
                     warehouses=spark.createDataFrame([], S.WAREHOUSES), apps=None)
    resumed = resume_plan(audit.audit_rows(plan, NOW), jobs).collect()
    assert [(r.resource_id, r.resume_action) for r in resumed] == [("200", "UNPAUSE")]


def test_run_resume_materialises_before_truncate(spark):
    table = _table()
    audit.append(_audit(spark, [("JOB", "200", "2026-04"), ("CLUSTER", "c1", "2026-04")]), table)
    plan = run_resume(spark, table, _jobs(spark))
    assert audit.read_audit(spark, table).count() == 0
    assert sorted(r.resume_action for r in plan.collect()) == ["START", "UNPAUSE"]
    assert run_resume(spark, table, _jobs(spark)) is None  # empty audit: nothing, no truncate
    assert run_resume(spark, "sg_missing.no_such_table", _jobs(spark)) is None


def test_run_resume_previous_month_clears_all(spark):
    table = _table()
    audit.append(_audit(spark, [("JOB", "200", "2026-03"), ("CLUSTER", "c1", "2026-04")]), table)
    plan = run_resume(spark, table, _jobs(spark), month_filter="previous", as_of=dt.date(2026, 4, 6))
    assert [r.resource_id for r in plan.collect()] == ["200"]
    assert audit.read_audit(spark, table).count() == 0


def test_default_now_stamps_one_time_and_its_month(spark):
    rows = audit.audit_rows(_plan(spark, [(1, "JOB", "1", "a"), (3, "CLUSTER", "c", "b")])).collect()
    stamps = {(r.timestamp, r.month) for r in rows}
    assert len(stamps) == 1
    ts, month = stamps.pop()
    assert month == ts.strftime("%Y-%m")


def test_read_table(spark, tmp_path):
    from spendguard.sources import read_table
    path = str(tmp_path / "apps")
    spark.createDataFrame([("a",), ("b",)], S.APPS).write.parquet(path)
    assert sorted(r.name for r in read_table(spark, path).collect()) == ["a", "b"]
    table = _table()
    audit.ensure_table(spark, table)
    assert read_table(spark, table).columns == list(S.AUDIT_COLUMNS)


def test_run_resume_into_named_plan_table(spark):
    table = _table()
    plan_table = table.replace("paused_jobs", "resume_plan")
    audit.append(_audit(spark, [("JOB", "200", "2026-04"), ("APP", "a", "2026-04")]), table)
    plan = run_resume(spark, table, _jobs(spark), plan_table=plan_table)
    assert audit.read_audit(spark, table).count() == 0
    assert sorted(r.resume_action for r in spark.table(plan_table).collect()) == ["START", "UNPAUSE"]
    assert plan.count() == 2


def test_append_and_clear_whatever_the_table_looks_like(spark, tmp_path):
    """Columns in another order and more of them, a name that needs quoting, an external table."""
    rows = audit.audit_rows(_plan(spark, [(1, "JOB", "41", "nightly")]), NOW)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reversed(S.AUDIT.fields))
    for name, extra, where in (("7_managed", "note STRING, ", ""), ("7_external", "", f" LOCATION '{tmp_path / 'there'}'")):
        name = f"{name}_{uuid.uuid4().hex[:8]}"
        spark.sql(f"CREATE TABLE `{name}` ({extra}{columns}) USING parquet{where}")
        assert audit.append(rows, name) == 1
        got = audit.read_audit(spark, name).collect()
        assert [(r.resource_type, r.resource_id, r.resource_name, r.month) for r in got] == [("JOB", "41", "nightly", "2026-04")]
        audit.clear(spark, name)
        assert audit.read_audit(spark, name).count() == 0 and audit.append(rows, name) == 1
        spark.sql(f"DROP TABLE `{name}`")


def test_append_to_a_table_without_a_column_is_refused(spark):
    name = f"sg_short_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TABLE {name} (resource_type STRING) USING parquet")
    with pytest.raises(ValueError, match="resource_id"):
        audit.append(audit.audit_rows(_plan(spark, [(1, "JOB", "41", "nightly")]), NOW), name)
    spark.sql(f"DROP TABLE {name}")


def test_default_clock_is_the_sessions(spark):
    """Without ``now`` and ``as_of`` the plans use the query's own time."""
    row = audit.audit_rows(_plan(spark, [(5, "APP", "a", "a")])).selectExpr("*", "current_timestamp() AS t", "date_format(current_date(), 'yyyy-MM') AS m").first()
    assert row.timestamp == row.t and row.month == row.m


def _recorded(spark, table):
    return sorted(((r.run_id or "", r.resource_type, r.resource_id) for r in spark.table(audit.quote_name(table)).collect()), key=str)


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_a_run_records_an_action_once(spark, rows):
    table = _table()
    plan = _plan(spark, [(1, "JOB", "1", "a"), (5, "APP", "x", "x"), (5, "APP", "x", "x"), (3, "CLUSTER", None, "n")])
    ok = lambda *types: spark.createDataFrame([(t, i, True) for t, i in types], "resource_type string, resource_id string, ok boolean")
    options = {"now": NOW, "max_broadcast_rows": rows}
    audit.append(audit.audit_rows(_plan(spark, [(1, "JOB", "1", "before runs had names")]), NOW), table)
    assert audit.record_actions(plan, table, run_id="r1", outcomes=ok(("JOB", "1")), **options) == 1
    assert audit.record_actions(plan, table, run_id="r1", outcomes=ok(("JOB", "1"), ("APP", "x")), **options) == 2  # the inventory lists x twice
    assert audit.record_actions(plan, table, run_id="r1", **options) == 1
    assert audit.record_actions(plan, table, run_id="r1", **options) == 0
    assert audit.record_actions(plan.where("resource_type = 'APP'"), table, run_id="r2", **options) == 2  # of another run
    assert _recorded(spark, table) == sorted([("", "JOB", "1"), ("r1", "JOB", "1"), ("r1", "APP", "x"), ("r1", "APP", "x"), ("r1", "CLUSTER", None), ("r2", "APP", "x"), ("r2", "APP", "x")], key=str)
    assert audit.read_audit(spark, table).columns == list(S.AUDIT_COLUMNS)


def test_rows_appended_while_a_resume_is_planned_stay(spark, jobs_df, monkeypatch):
    """Another run appends between the plan and the clear: with "planned" its rows are still there."""
    from spendguard.plans import resume as resume_module

    jobs = jobs_df([job(1, "PAUSED"), job(2, "PAUSED")])
    late = audit.audit_rows(_plan(spark, [(1, "JOB", "2", "late")]), NOW)
    planned = resume_module.resume_plan

    def run(clear):
        table = _table()
        audit.append(audit.audit_rows(_plan(spark, [(1, "JOB", "1", "a"), (5, "APP", "x", "x")]), NOW), table)

        def slow(*args, **kwargs):
            out = planned(*args, **kwargs)
            audit.append(late, table)
            return out

        monkeypatch.setattr(resume_module, "resume_plan", slow)
        plan = run_resume(spark, table, jobs, clear=clear)
        return sorted(r.resource_id for r in plan.collect()), [r.resource_id for r in audit.read_audit(spark, table).collect()]

    assert run("planned") == (["1", "x"], ["2"])
    assert run("all")[1] == []
    with pytest.raises(ValueError):
        run_resume(spark, _table(), jobs, clear="some")


def test_planned_rows_of_one_month_leave_the_others(spark, jobs_df):
    table = _table()
    for month in (2, 3, 4):
        audit.append(audit.audit_rows(_plan(spark, [(1, "JOB", str(month), "a")]), dt.datetime(2026, month, 9)), table)
    options = {"month_filter": "previous", "as_of": dt.date(2026, 4, 20)}
    plan = run_resume(spark, table, jobs_df([]), clear="planned", **options)
    assert [r.resource_id for r in plan.collect()] == ["3"]
    assert sorted(r.resource_id for r in audit.read_audit(spark, table).collect()) == ["2", "4"]
    assert run_resume(spark, table, jobs_df([]), clear="planned", **options) is None
    run_resume(spark, table, jobs_df([]))
    assert audit.read_audit(spark, table).count() == 0


def test_a_listing_that_is_not_there_is_empty(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from spendguard.plans import app_stop_plan
    from spendguard.sources import read_listing

    spark.createDataFrame([("a1", 5)], "name string, more int").write.parquet(str(tmp_path / "apps"))
    assert [r.name for r in app_stop_plan(str(tmp_path / "apps")).collect()] == ["a1"]
    (tmp_path / "empty").mkdir()
    for source in (str(tmp_path / "none.parquet"), "no_such_schema.apps", "no_such_table", str(tmp_path / "empty")):
        assert app_stop_plan(source).collect() == []
        with pytest.raises(AnalysisException):
            read_listing(spark, source, S.APPS, required=True)
    spark.createDataFrame([(5,)], "other int").write.parquet(str(tmp_path / "odd"))
    assert read_listing(spark, str(tmp_path / "odd"), S.APPS).collect() == []
