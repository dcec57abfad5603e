"""What large and dense tables show: frames that run, no step twice, windows that are all full."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.operators import accounting, attacks, gate, lenses, profile, rewrites, stack
from watchgrid.plans import behaviour, catalog
from watchgrid.sources import tables, views

SF = "/root/testdata/sf0.01"

#: Queries whose plans may hold no frame from a row to the end of its group.
DENSE = (
    "lens_books",
    "ablation",
    "detection_curves",
    "detection_matrix",
    "coverage_plateau",
    "failure_correlation",
    "false_alarm_rate",
    "ensemble_caught",
    "full_stack_alarms",
    "leave_one_out",
    "monitor_correlations",
    "obstruction_rate",
    "redundancy",
    "monitor_rates",
    "near_copies",
    "stack_calibration",
    "stack_margins",
    "stack_alarms",
    "strengths_caught",
    "time_drift",
)


@pytest.mark.parametrize("name", DENSE)
def test_frames_run(spark, monkeypatch, name):
    """A frame from a row to the end of its group is evaluated anew for every row: such a query does not end on dense traces."""
    plans, real = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df: (plans.append(df), real(df))[1])
    plans.append(catalog.QUERIES[name](spark, SF))
    text = "".join(df._jdf.queryExecution().analyzed().toString() for df in plans)
    assert "unboundedpreceding$(), currentrow$()" in text
    assert "currentrow$(), unboundedfollowing$()" not in text


def test_gate_takes_each_step_once(spark, monkeypatch):
    calls = []

    def counted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(name), real(*a, **k))[1])

    counted(lenses, "series")
    counted(accounting, "reviewed")
    got = {r["id"]: r["value"] for r in catalog.QUERIES["gate_decision"](spark, SF).collect()}
    assert calls.count("series") == 1
    assert calls.count("reviewed") == 2  # the changes with their reviews, and in reconcile the reviews without a change
    assert got["accounting"] == catalog.QUERIES["reconcile"](spark, SF).where(F.col("kind").isin(*gate.ACCOUNTING)).count()


def test_given_changes_give_the_same_accounts(spark):
    records = tables.written(views.updates(spark, SF))
    changes = tables.written(accounting.reviewed(records)[0])
    assert accounting.assessed(records, changes=changes) == pytest.approx(accounting.assessed(records))
    assert accounting.reconcile(records, changes=changes).exceptAll(accounting.reconcile(records)).isEmpty()


def test_agent_information_where_windows_are_full(spark, tmp_path):
    """Agents 0 and 1 view in every window: no label tells them apart. Agent 3 has few marks."""
    marks = [(w, a) for w in range(40) for a in (0, 1)] + [(w, 2) for w in range(0, 40, 2)] + [(w, 3) for w in (0, 1, 4, 9)]
    rows = [(i, w * 600.0, a, "view", 1.0, "{}") for i, (w, a) in enumerate(marks)] + [(1000 + w, w * 600.0 + 1, 3, "click", 1.0, "{}") for w in (2, 3)] + [(1100, 1202.0, 1, "click", 1.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'; CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    theirs = sorted(con.execute(catalog.ORACLE_SQL["agent_information"]).fetchall())
    mine = sorted(map(tuple, catalog.QUERIES["agent_information"](spark, str(tmp_path)).collect()))
    assert [r[:2] for r in mine] == [r[:2] for r in theirs] == [("1", "3"), ("2", "3")]
    assert [r[2] for r in mine] == pytest.approx([r[2] for r in theirs], abs=1e-8)


def dense(spark):
    """A trace of an event in every quarter of a second, twinned a little later but for each thousandth, on absolute time."""
    ev = spark.range(40_000).select(F.lit(0).cast("long").alias("trace_id"), F.col("id").alias("seq"), (1e9 + F.col("id") / 4).alias("t"), F.lit(0).alias("agent"), (F.col("id") % 6).cast("int").alias("kind"))
    ev = ev.select("*", (F.col("seq") % 9).cast("int").alias("target"), F.lit(1.0).alias("size"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("chan"))
    twin = ev.where("seq % 1000 <> 7").withColumns({"t": F.col("t") + 0.25, "chan": F.lit(1)})
    return ev.unionByName(twin)


def test_dense_buckets_leave_few_rows_to_the_windows(spark, monkeypatch):
    """Rows that a twin surely meets don't get into the sorted windows."""
    left, real = [], tables.small
    monkeypatch.setattr(tables, "small", lambda df: (left.append(real(df)), left[-1])[1])
    ev = dense(spark).withColumn("t", F.when(F.col("seq") == 20_000, F.col("t") + 1e6).otherwise(F.col("t")))
    got = rewrites.unmatched(ev.where("seq <> 20000 OR chan = 0"), ["trace_id", "kind"], "t", "chan", 2.0).select("seq").collect()
    assert [r["seq"] for r in got] == [20_000]
    assert len(left) == 1 and left[0].count() == 1


def test_unmatched_on_odd_rows(spark):
    """Any tolerance, keys, sides and times that are null or huge."""
    rng = np.random.default_rng(5)
    rows = [(None if k == 2 else int(k), float(t) - 20, int(c), i) for i, (k, t, c) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 2000, 200) / 8, rng.integers(0, 2, 200), strict=True))]
    rows += [(0, None, 0, 1000), (0, 1e300, 0, 1001), (0, 3.0, None, 1002), (1, -0.0, 0, 1003), (1, 1e17, 1, 1004)]
    known = lambda *x: None not in x
    for tol in (2.0, 1.5, 0.3, 0.0):
        got = sorted(r["i"] for r in rewrites.unmatched(spark.createDataFrame(rows, "k int, t double, c int, i int"), ["k"], "t", "c", tol).collect())
        assert got == sorted(i for k, t, c, i in rows if not any(k2 == k and known(c, c2, t, t2) and c2 != c and abs(t2 - t) <= tol for k2, t2, c2, _ in rows))


def test_chunks_are_cut_without_a_shuffle(spark):
    """A join by trace would bring a long trace into one task."""
    out = profile.chunked(dense(spark), 1000.0, 100)
    assert out.select("trace_id").distinct().count() == 10
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_only_tokens_of_the_template_are_sorted(spark):
    df = dense(spark).where("chan = 0")
    out = rewrites.chain_ends(df, ["trace_id"], ["t", "seq"], F.col("kind"), [3, 0, 5], "t")
    kinds = [(r["t"], r["kind"]) for r in df.orderBy("t").limit(60).collect()]
    want = []
    for i, (t, k) in enumerate(kinds):
        if k == 3 and (a := next((j for j in range(i + 1, 60) if kinds[j][1] == 0), None)) and (b := next((x for x, k2 in kinds[a + 1 :] if k2 == 5), None)):
            want.append((t, b))
    assert sorted(map(tuple, out.where(F.col("end") <= kinds[-1][0]).select("t", "end").collect())) == want
    below = out._jdf.queryExecution().optimizedPlan().toString().rsplit("Window [", 1)[1]
    assert "IN (" in below and "Filter" in below


def test_rhythm_and_surprisal_share_a_sort(spark):
    trace = profile.chunked(dense(spark), 1000.0, 100)
    both = lenses.series(trace, model.DEFAULT_PROFILE, ("rhythm", "burst", "surprisal"))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    for n in ("rhythm", "surprisal"):
        own, shared = lenses.LENSES[n](trace, model.DEFAULT_PROFILE), both.where(F.col("lens") == n)
        plain = lambda df: sorted(map(tuple, df.select("trace_id", "ts", F.round("score", 9)).collect()))
        assert plain(shared) == plain(own) and own.count() == 40


def test_chains_share_a_sort(spark):
    """The templates that lie in one trace are found by one shuffle, each as by its own."""
    trace = profile.chunked(dense(spark), 1000.0, 100)
    every = lenses.series(trace, model.DEFAULT_PROFILE, tuple(model.TEMPLATES))
    assert every._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plain = lambda df: sorted(map(tuple, df.select("trace_id", F.round("ts", 9), F.round("score", 9)).collect()))
    for n in model.TEMPLATES:
        steps = [model.TOKENS[x] for x in model.TEMPLATES[n]]
        rows = trace.where("chan = 0 AND trace_id = 3").orderBy("t", "seq").select("t", F.expr("CASE WHEN kind = 1 AND target < 7 THEN 6 ELSE kind END")).limit(300).collect()
        want = []
        for i, (t, k) in enumerate(rows):
            at = i if k == steps[0] else None
            for s in steps[1:]:
                at = None if at is None else next((j for j in range(at + 1, len(rows)) if rows[j][1] == s), None)
            if at is not None:
                want.append((3, round(rows[at][0], 9), round(max(0.0, math.log(3600.0 / (rows[at][0] - t + 1.0))), 9)))
        own = every.where(F.col("lens") == n)
        assert want and plain(own.where((F.col("trace_id") == 3) & (F.col("ts") <= rows[-1][0]))) == sorted(want)


def test_detectors_leave_the_other_record_alone(spark):
    """A detector of reported events reads their table only, and the scores start no Python worker."""
    trace = behaviour._chunks(spark, SF)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(trace.where("chan = 0")).count("parquet") == plan(trace.where("chan = 1")).count("parquet") + 1  # and the chunks that are large enough
    assert "Union" not in plan(trace.where("chan = 0"))
    assert "LogicalRDD" not in plan(stack.scores(lenses.series(trace, behaviour.PROFILE, ("burst",)), trace, ("burst",)))


def test_local_rows(spark):
    rows = [("a", 1, None, 0.5), ("b", 2, "x", None)]
    df = tables.local(spark, rows, "a string, b int, c string, d double")
    assert sorted(map(tuple, df.collect())) == rows and df.schema.simpleString() == "struct<a:string,b:int,c:string,d:double>"
    assert tables.local(spark, [], "a string, b int").count() == 0


def test_unmatched_sorts_buckets_only(spark):
    """Rows are compared with what a sort of the buckets found: none of them is sorted. Tolerances of nearly four buckets, times around their ends."""
    out = rewrites.unmatched(dense(spark), ["trace_id", "kind"], "t", "chan", 2.0)
    assert "Window [" not in out._jdf.queryExecution().optimizedPlan().toString()
    rng = np.random.default_rng(8)
    rows = [(int(k), float(t) / 16 - 9, int(c), i) for i, (k, t, c) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 1600, 300), rng.random(300) < 0.3, strict=True))]
    for tol in (1.9, 0.99, 0.5, 4.0):
        got = sorted(r["i"] for r in rewrites.unmatched(spark.createDataFrame(rows, "k int, t double, c int, i int"), ["k"], "t", "c", tol).collect())
        want = sorted(i for k, t, c, i in rows if not any(k2 == k and c2 != c and abs(t2 - t) <= tol for k2, t2, c2, _ in rows))
        assert got == want and 0 < len(got) < 300


def test_counts_share_a_reading(spark):
    names = ("sweep", "ctrl", "netvol")
    trace = profile.chunked(dense(spark).withColumn("target", F.when(F.col("seq") % 50 > 0, F.col("target"))), 1000.0, 100)
    every = lenses.series(trace, model.DEFAULT_PROFILE, names)
    assert "Union" not in every._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[0]
    plain = lambda df: sorted(map(tuple, df.select("trace_id", F.round("ts", 9), F.round("score", 9)).collect()))
    for n in names:
        own = plain(lenses.LENSES[n](trace, model.DEFAULT_PROFILE))
        assert own and plain(every.where(F.col("lens") == n)) == own


def test_scores_need_no_join(spark):
    """A trace without a series has a score of 0, a series without a trace none."""
    ids = spark.createDataFrame([(1,), (2,), (2,)], "trace_id long")
    series = spark.createDataFrame([(1, "a", 0.0, 3.0), (1, "a", 1.0, 2.0), (1, "b", 1.0, -2.0), (3, "a", 0.0, 9.0), (2, "other", 0.0, 9.0), (2, "b", 0.0, None)], "trace_id long, lens string, ts double, score double")
    for traces in (ids, ids.withColumn("t", F.lit(0.0))):
        out = stack.scores(series, traces, ("a", "b"))
        assert sorted(map(tuple, out.collect())) == [(1, "a", 3.0), (1, "b", -2.0), (2, "a", 0.0), (2, "b", 0.0)]
        assert "Join LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_detectors_run_once_over_attacks_and_clean_chunks(spark, monkeypatch):
    calls, real = [], lenses.series
    monkeypatch.setattr(lenses, "series", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    assert catalog.QUERIES["detection_curves"](spark, SF).count() == 30
    assert len(calls) == 2  # of all chunks for the thresholds, and of the attacks with their clean chunks


@pytest.mark.parametrize("name", sorted(set(DENSE) - {"lens_books", "ablation", "detection_matrix"}))
def test_no_row_is_sorted_for_the_books(spark, monkeypatch, name):
    """A RANGE frame over rows sorts both records; buckets need none."""
    plans, real = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df: (plans.append(df), real(df))[1])
    plans.append(catalog.QUERIES[name](spark, SF))
    assert "RangeFrame" not in "".join(df._jdf.queryExecution().analyzed().toString() for df in plans)


def test_every_later_chunk_is_attacked(spark, monkeypatch):
    """No chunk of the part that is not calibrated on is left out of the curves, and none is left to chance."""
    tried, real = [], attacks.injected
    monkeypatch.setattr(attacks, "injected", lambda chunks, prof, names, items, *a: (tried.append(items), real(chunks, prof, names, items, *a))[1])
    rows = catalog.QUERIES["detection_curves"](spark, SF).collect()
    chunks = [r["trace_id"] for r in views.chunks(spark, SF).select("trace_id").distinct().orderBy("trace_id").collect()]
    later = chunks[int(len(chunks) * 0.6) :]
    assert len(later) > 8 and len(rows) == 30 and {r["n"] for r in rows} == {3 * len(later)}
    assert {(r["base"], r["count"]) for r in tried[0].groupBy("base").count().collect()} == {(b, 90) for b in later}
    assert tried[0].select("item").distinct().count() == tried[0].count()


@pytest.mark.parametrize("tau", [0.5, 3.0])
def test_laid_over_events_score_as_in_copies(spark, tau):
    """The detectors that read a base chunk once say of every item what they say of a copy of the chunk with the item's events."""
    rng = np.random.default_rng(int(tau * 2))
    rows = []
    for trace in range(3):
        for i in range(600):
            t, kind = float(np.round(rng.uniform(0, 4000), 2)), int(rng.integers(6))
            target = None if i % 40 == 0 else int(rng.integers(30))
            rows.append((trace, i, t, 0, kind, target, float(i % 7), None, 0))
            if trace and i % 5:  # the first trace has no independent record
                rows += [(trace, None, t + 0.25 + 3.0 * (i % 4 == 0), 0, kind, None, None, None, 1)] * (1 + (i % 9 == 0))
    rows.append((1, 1000, 50.0, 0, None, 3, 1.0, None, 0))
    bases = tables.written(spark.createDataFrame(rows, model.TRACE_SCHEMA))
    items = spark.createDataFrame([(i, i % 3) for i in range(12)], "item long, base long")
    extra = []
    for i in range(12):
        for at in np.sort(rng.uniform(0, [8.0, 300.0, 3900.0][i // 4], 25)) + rng.uniform(0, 90):
            extra.append((i, i % 3, float(at), int(rng.integers(6)), int(rng.integers(40)), 5.0))
        extra += [(i, i % 3, float(rows[100][2]), int(rows[100][4]), 3, 1.0)] * 2  # at the time of another event, twice
    extra = tables.written(spark.createDataFrame(extra, "item long, base long, t double, kind int, target int, size double"))
    names, prof = lenses.local(lenses.DEFAULT), model.DEFAULT_PROFILE
    assert names == ["burst", "sweep", "ctrl", "netvol", "books", *model.TEMPLATES]
    base_of = {r["item"]: r["base"] for r in items.collect()}
    seen = lambda df: {(r["trace_id"], r["lens"], round(r["ts"], 9), round(r["score"], 9)) for r in df.where(f"score > {tau} AND ts IS NOT NULL").collect()}
    clean = seen(lenses.series(bases, prof, names))
    new = lambda found: {x for x in found if (base_of[x[0]], *x[1:]) not in clean}
    copied = new(seen(lenses.series(tables.written(attacks.overlaid(bases, items, extra)), prof, names)))
    assert {x[1] for x in copied} == set(names)
    assert new(seen(lenses.altered(bases, extra, prof, names, dict.fromkeys(names, tau)))) == copied
