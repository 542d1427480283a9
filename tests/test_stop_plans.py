"""Stop plans against a plain evaluation of their rules, on random inventories; then the corners."""

from __future__ import annotations

import random

import pytest
from conftest import ids, job, schedule, settings
from pyspark.sql import functions as F

from spendguard import schemas as S
from spendguard.functions import parse_targets
from spendguard.operators import CheckedIds, check_id_sets
from spendguard.plans import (
    action_counts,
    app_stop_plan,
    cluster_stop_plan,
    enforcement_plan,
    gated_stop_plan,
    job_stop_plan,
    run_cancel_plan,
    stop_plan,
    take_snapshot,
    warehouse_stop_plan,
)

OWN, RESUMER, OWN_CLUSTER = 8101, 8102, "k-own"
EXEMPT = [str(OWN), str(RESUMER)]
STATES = ["RUNNING", "RESIZING", "PENDING", "TERMINATED", "STARTING", "STOPPED", "DELETING", None]


class Inventory:
    """Rows drawn at random, with the two exempt jobs and the own cluster among them."""

    def __init__(self, seed):
        rng = random.Random(seed)
        self.jobs = [(i, rng.choice(["none", "paused", "live"])) for i in [OWN, RESUMER, *rng.sample(range(1, 8000), 12)]]
        known = [i for i, _ in self.jobs] + [None, 9999]
        self.runs = [(100 + k, rng.choice(known), rng.choice([True, True, False, None])) for k in range(20)]
        self.clusters = [(c, f"name of {c}", rng.choice(STATES)) for c in [OWN_CLUSTER, *(f"k-{n}" for n in range(9))]]
        self.warehouses = [(f"h{n}", f"H {n}", rng.choice(STATES)) for n in range(9)]
        self.apps = [f"app-{n}" for n in range(6)]
        pool = [str(i) for i, _ in self.jobs] + [r[0] for r in self.clusters + self.warehouses] + self.apps
        self.some = rng.sample(pool, len(pool) // 2) + [str(OWN), OWN_CLUSTER, "unheard-of"]

    def frames(self, spark):
        made = {"none": None, "paused": settings("j", schedule=schedule(status="PAUSED")), "live": settings("j", schedule=schedule())}
        return dict(
            jobs=spark.createDataFrame([(i, made[kind]) for i, kind in self.jobs], S.JOBS),
            clusters=spark.createDataFrame(self.clusters, S.CLUSTERS),
            warehouses=spark.createDataFrame(self.warehouses, S.WAREHOUSES),
            apps=spark.createDataFrame([(a,) for a in self.apps], S.APPS))

    def expected(self, wanted):
        """What each plan must hold when ``wanted(id as text)`` says what is targeted."""
        exempt = set(EXEMPT)
        return dict(
            jobs={i for i, kind in self.jobs if kind == "live" and str(i) not in exempt and wanted(str(i))},
            runs={r for r, i, active in self.runs if active and str(i) not in exempt and wanted(str(i))},
            clusters={c for c, _, state in self.clusters if c != OWN_CLUSTER and state in S.ACTIVE_CLUSTER_STATES and wanted(c)},
            warehouses={w for w, _, state in self.warehouses if state in S.ACTIVE_WAREHOUSE_STATES and wanted(w)},
            apps={a for a in self.apps if wanted(a)})


def _targets(spark, inventory, form):
    """A target set in one of the forms a caller may give it, and what it means."""
    some = set(inventory.some)
    if form == "everything":
        return None, {}, lambda x: True
    if form == "nothing":
        return parse_targets(spark, " , ,"), {}, lambda x: False
    if form == "list":
        return inventory.some, {}, some.__contains__
    table = spark.createDataFrame([(x,) for x in inventory.some * 2], "target_id string")
    return table, {"max_broadcast_rows": 0} if form == "shuffled table" else {}, some.__contains__


@pytest.mark.parametrize("form", ["everything", "nothing", "list", "table", "shuffled table"])
def test_plans_follow_their_rules(spark, form):
    inventory = Inventory(form)
    frames = inventory.frames(spark)
    targets, options, wanted = _targets(spark, inventory, form)
    runs = spark.createDataFrame(inventory.runs, S.RUNS)
    got = dict(
        jobs=ids(job_stop_plan(frames["jobs"], targets=targets, exempt=EXEMPT, **options), "job_id"),
        runs=ids(run_cancel_plan(runs, targets=targets, exempt=EXEMPT, **options), "run_id"),
        clusters=ids(cluster_stop_plan(frames["clusters"], targets=targets, own_cluster_id=OWN_CLUSTER, **options), "cluster_id"),
        warehouses=ids(warehouse_stop_plan(frames["warehouses"], targets=targets, **options), "id"),
        apps=ids(app_stop_plan(frames["apps"], targets=targets, **options), "name"))
    assert got == {k: sorted(v) for k, v in inventory.expected(wanted).items()}


def test_a_list_that_says_all_in_a_table_of_lists(spark):
    from spendguard.functions import explode_target_lists

    inventory = Inventory("lists")
    frames = inventory.frames(spark)
    lists = spark.createDataFrame([("app-1, h2",), (" All ",), (",",)], "raw string")
    for part, expected in ((lists, lambda x: True), (lists.where("raw not like '%All%'"), {"app-1", "h2"}.__contains__)):
        targets = explode_target_lists(part)
        for options in ({}, {"max_broadcast_rows": 0}):
            assert ids(app_stop_plan(frames["apps"], targets=targets, **options), "name") == sorted(inventory.expected(expected)["apps"])
    exempt = explode_target_lists(lists)  # an exempt table that says ALL spares every job
    assert job_stop_plan(frames["jobs"], exempt=exempt).count() == 0


def test_numbers_in_target_text_match_ids_and_padded_ids_do_not(spark):
    frames = dict(jobs=spark.createDataFrame([job(640000000000123), job(77)], S.JOBS),
                  clusters=spark.createDataFrame([("0077", "padded", "RUNNING")], S.CLUSTERS))
    targets = parse_targets(spark, "6.40000000000123e+14, 0077")
    assert ids(job_stop_plan(frames["jobs"], targets=targets), "job_id") == [77, 640000000000123]
    assert ids(cluster_stop_plan(frames["clusters"], targets=targets), "cluster_id") == []


def test_blank_exempt_ids_exempt_nothing(spark):
    jobs = spark.createDataFrame([job(5), job(6)], S.JOBS)
    assert ids(job_stop_plan(jobs, exempt=[None, ""]), "job_id") == [5, 6]


def test_unknown_own_job_id_exempts_runs_without_job(spark):
    runs = spark.createDataFrame([(1, None, True), (2, 44, True)], S.RUNS)
    assert ids(run_cancel_plan(runs, exempt=[None, "61"]), "run_id") == [2]
    assert ids(run_cancel_plan(runs, exempt=["60", "61"]), "run_id") == [1, 2]


def test_job_kinds_and_pause_rewrites(jobs_df):
    trig = ('{"url": "/x"}', None, "UNPAUSED")
    jobs = jobs_df([
        (1, settings("sched", schedule=schedule("0 0 8 * * ?", "Europe/Paris", "UNPAUSED"))),
        (2, settings("cont", continuous=("UNPAUSED",))),
        (3, settings("trig", trigger=trig)),
        (4, settings("manual")),
        (5, settings("both", schedule=schedule(status=None), trigger=("f", "t", "PAUSED"))),
        (6, settings("paused", continuous=("PAUSED",))),
        (7, settings("paused-trig", trigger=("f", None, "PAUSED"))),
        (8, settings("empty-struct", schedule=(None, None, None))),
    ])
    rows = {r.job_id: r for r in job_stop_plan(jobs).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 8]  # 6 and 7 are already paused
    assert rows[1].job_kind == "SCHEDULE"
    assert tuple(rows[1].new_settings.schedule) == ("0 0 8 * * ?", "Europe/Paris", "PAUSED")
    assert rows[1].new_settings.continuous is None and rows[1].new_settings.trigger is None
    assert rows[2].job_kind == "CONTINUOUS" and tuple(rows[2].new_settings.continuous) == ("PAUSED",)
    assert rows[2].new_settings.schedule is None
    assert tuple(rows[3].new_settings.trigger) == ('{"url": "/x"}', None, "PAUSED")
    assert rows[4].job_kind == "ON_DEMAND"
    assert tuple(rows[4].new_settings.schedule) == (S.PLACEHOLDER_CRON, "UTC", "PAUSED")
    # schedule wins over trigger; a NULL pause status is not paused
    assert rows[5].job_kind == "SCHEDULE" and rows[5].new_settings.trigger is None
    # a present struct with NULL fields still counts as a schedule
    assert rows[8].job_kind == "SCHEDULE" and tuple(rows[8].new_settings.schedule) == (None, None, "PAUSED")


def test_cluster_states_null_and_case(clusters_df):
    c = clusters_df([("a", "A", "RESIZING"), ("b", "B", "PENDING"), ("c", "C", None), ("d", "D", "running"),
                     (None, "nameless", "RUNNING")])
    assert ids(cluster_stop_plan(c, own_cluster_id="x"), "cluster_name") == ["A", "B", "nameless"]
    # With no own id known, a cluster with no id equals it (NULL-safe), as in the original check.
    assert ids(cluster_stop_plan(c, own_cluster_id=None), "cluster_name") == ["A", "B"]


def test_missing_app_listing_is_empty(spark):
    assert app_stop_plan(None).count() == 0


# --- union, gate, snapshot ------------------------------------------------------------------------

def _status(spark, status, spend="1.0"):
    return spark.createDataFrame([(status, spend)], "budget_status string, current_spend string")


def test_union_holds_every_plan_with_its_step(spark):
    inventory = Inventory("union")
    inventory.apps.append(inventory.apps[0])  # a repeated row stays repeated
    expected = inventory.expected(lambda x: True)
    plan = stop_plan(**inventory.frames(spark), exempt_jobs=EXEMPT, own_cluster_id=OWN_CLUSTER)
    rows = sorted((r.step, r.resource_type, r.resource_id) for r in plan.collect())
    assert rows == sorted([(1, "JOB", str(i)) for i in expected["jobs"]] + [(3, "CLUSTER", c) for c in expected["clusters"]]
                          + [(4, "WAREHOUSE", w) for w in expected["warehouses"]] + [(5, "APP", a) for a in inventory.apps])
    counts = {r.resource_type: r.actions for r in action_counts(plan).collect()}
    assert counts["APP"] == len(inventory.apps) and sum(counts.values()) == len(rows)


@pytest.mark.parametrize("verdict", ["OVER_BUDGET", "WITHIN_BUDGET", None])
def test_gate_opens_only_over_budget(spark, verdict):
    inventory = Inventory("gate")
    args = dict(inventory.frames(spark), exempt_jobs=EXEMPT, own_cluster_id=OWN_CLUSTER)
    runs = spark.createDataFrame(inventory.runs, S.RUNS)
    expected = inventory.expected(lambda x: True)
    n = sum(len(v) for k, v in expected.items() if k != "runs") if verdict == "OVER_BUDGET" else 0
    cancelled = sorted(expected["runs"]) if verdict == "OVER_BUDGET" else []
    assert gated_stop_plan(_status(spark, verdict), **args).count() == n
    for make in (enforcement_plan, take_snapshot):
        plan = make(_status(spark, verdict), runs=runs, **args)
        assert plan.stops.count() == n and ids(plan.runs, "run_id") == cancelled
        assert make(_status(spark, verdict), **args).runs.count() == 0


def test_snapshot_stays_when_the_inventory_changes(spark, tmp_path):
    path = str(tmp_path / "clusters")
    before = [("k1", "one", "RUNNING"), ("k2", "two", "PENDING")]
    spark.createDataFrame(before, S.CLUSTERS).write.parquet(path)
    args = dict(Inventory("snapshot").frames(spark), clusters=spark.read.schema(S.CLUSTERS).parquet(path))
    kept = take_snapshot(_status(spark, "OVER_BUDGET"), **args)
    named = take_snapshot(_status(spark, "OVER_BUDGET"), stops_table="7_sg_stops", runs_table="7_sg_runs", **args)
    spark.createDataFrame([(c, n, "TERMINATED") for c, n, _ in before], S.CLUSTERS).write.mode("overwrite").parquet(path)
    for plan in (kept, named):
        assert ids(plan.stops.where("resource_type = 'CLUSTER'"), "resource_id") == ["k1", "k2"]
    for name in ("7_sg_stops", "7_sg_runs"):
        spark.sql(f"DROP TABLE `{name}`")


def test_id_sets_are_counted_once_and_keep_their_duplicates(spark):
    shared = spark.createDataFrame([("1",), ("2",), ("2",)], "target_id string")
    other = spark.createDataFrame([("x",)], "id string")
    a, b, c, d, e = check_id_sets([shared, other, shared, None, ["9"]])
    assert isinstance(a, CheckedIds) and a is c and a.broadcast
    assert isinstance(b, CheckedIds) and d is None and e == ["9"]
    big = check_id_sets([shared], max_broadcast_rows=2)[0]
    assert not big.broadcast and sorted(r[0] for r in big.ids.collect()) == ["1", "2", "2"]


def test_hot_job_id_is_split_in_semi_and_anti_joins(spark):
    """Half of the runs belong to one job: on the shuffle path AQE splits its partition (the
    thresholds are lowered to this data size)."""
    runs = spark.range(20_000).select(F.col("id").alias("run_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("job_id"),
                                      F.lit(True).alias("active"))
    table = spark.range(4_000).select(F.col("id").cast("string").alias("target_id"))
    lowered = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in lowered}
    try:
        for k, v in lowered.items():
            spark.conf.set(k, v)
        for plan, n in ((run_cancel_plan(runs, targets=table, max_broadcast_rows=0), 12_000 - 1), (run_cancel_plan(runs, exempt=table, max_broadcast_rows=0), 8_000)):
            rows = plan.collect()
            assert abs(len(rows) - n) <= 1
            assert "SortMergeJoin(skew=true)" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_concurrent_checks_run_in_the_callers_job_group(spark):
    sc = spark.sparkContext
    sets = [spark.createDataFrame([(str(i),)], "target_id string") for i in range(3)]
    sc.setJobGroup("sg-checks", "size checks")
    try:
        check_id_sets(sets)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("sg-checks")) >= 3
