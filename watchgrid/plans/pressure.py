"""Queries on attacks, drift and lineage."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.operators import accounting, attacks, drift, lenses, profile, stack, weights
from watchgrid.plans import accounts, behaviour
from watchgrid.plans.behaviour import _round
from watchgrid.sources import files, tables, views
from watchgrid.sources.incidents import INCIDENTS

QUERIES, ORACLE_SQL = {}, {}
_FAST = ("burst", "sweep", "ctrl", "netvol", "books", "drift_chain")


def library_events(spark, sf_dir):
    """How many events of each kind and channel the known attacks have."""
    specs = [attacks.Spec(n, p, t0=1000.0) for n, p in attacks.LIBRARY.items()]
    return attacks.render(spark, specs).groupBy("attack", "kind", "chan").agg(F.count("*").alias("n"))


QUERIES["library_events"] = library_events
_STEPS = ", ".join(
    f"('{n}', {prim}, '{shape}', {count}, '{kind}', {model.WRITE if kind == 'ctrl' else model.KINDS.index(kind)})" for n, p in attacks.LIBRARY.items() for prim, shape, count, kind, *_ in attacks._steps(attacks.Spec(n, p, t0=1000.0))
)
ORACLE_SQL["library_events"] = f"""WITH e AS (SELECT *, unnest(range(m)) AS i FROM (VALUES {_STEPS}) x(attack, prim, shape, m, name, kind)),
k AS (SELECT attack, CAST(shape = 'unlogged' AS INT) AS chan, CASE WHEN shape = 'unlogged' AND ('0x' || substr(md5(concat_ws(':', attack, 0, prim, name, i, 'k')), 1, 8))::UBIGINT / 4294967296.0 < 0.5 THEN {model.NET} ELSE kind END AS kind FROM e)
SELECT attack, kind, chan, count(*) AS n FROM (SELECT * FROM k UNION ALL SELECT attack, 1, kind FROM k WHERE chan = 0) GROUP BY attack, kind, chan"""


def incident_events(spark, sf_dir):
    out = None
    for n in files.list_incidents():
        own = attacks.incident(files.incident_phases(spark, n)).groupBy("attack", "chan").agg(F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


QUERIES["incident_events"] = incident_events
_PHASES = ", ".join(f"('{n}', {p['actions']})" for n in files.list_incidents() for p in INCIDENTS[n]["phases"])
ORACLE_SQL["incident_events"] = f"SELECT attack, CAST(c.chan AS INT) AS chan, CAST(sum(actions) AS BIGINT) AS n FROM (VALUES {_PHASES}) p(attack, actions), (VALUES (0), (1)) c(chan) GROUP BY attack, c.chan"


def _cal(spark, sf_dir, names):
    trace, ids = behaviour._chunked(spark, sf_dir, names)
    s = stack.scores(lenses.series(trace, behaviour.PROFILE, names), ids, names).join(stack.split_chronological(ids), "trace_id")
    return trace, tables.written(s)


def detection_curves(spark, sf_dir):
    """Attacks of every shape and strength in every later chunk, before detectors calibrated on the first ones."""
    trace, s = _cal(spark, sf_dir, _FAST)
    th = tables.written(stack.calibrate(s.where("part = 'cal'"), len(_FAST)))
    bases = s.where("part = 'val'").select("trace_id").distinct()
    stats = profile.scale_statistics(trace).first().asDict()
    return attacks.detection_curves(trace, behaviour.PROFILE, _FAST, bases, th, stats, asdict(behaviour.PROFILE)["p_kind"])


QUERIES["detection_curves"] = detection_curves


def transfer_matrix(spark, sf_dir):
    """Chunks of even and odd days as two groups: thresholds of one on the other."""
    s = behaviour._scores(spark, sf_dir)
    groups = s.select("trace_id").distinct().withColumn("grp", F.when(F.floor(F.col("trace_id") / 2) % 2 == 0, "even").otherwise("odd"))
    return _round(drift.transfer(s, groups, len(behaviour.PLAIN)), "rate", "low", "high")


QUERIES["transfer_matrix"] = transfer_matrix
_P = "(p + 3.8416 / (2 * n) {0} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"
ORACLE_SQL["transfer_matrix"] = f"""WITH {behaviour._scores_sql()},
g AS (SELECT trace_id, CASE WHEN (trace_id // 2) % 2 = 0 THEN 'even' ELSE 'odd' END AS grp FROM big), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY trace_id) <= floor(count(*) OVER (PARTITION BY grp) * 0.6) AS cal FROM g),
t AS (SELECT grp AS a, lens, list_sort(list(score))[CAST(ceil((1 - 0.05 / {len(behaviour.PLAIN)}) * (count(*) - 1)) AS INT) + 1] AS tau FROM sc JOIN o USING (trace_id) WHERE cal GROUP BY 1, 2),
h AS (SELECT t.a, o.grp AS b, sc.trace_id, max(CAST(score > tau AS INT)) AS alarm FROM sc JOIN o USING (trace_id) JOIN t USING (lens) WHERE NOT cal GROUP BY 1, 2, 3),
rt AS (SELECT a, b, count(*) AS n, CAST(sum(alarm) AS BIGINT) AS alarms, sum(alarm) / count(*) AS p FROM h GROUP BY 1, 2)
SELECT a, b, n, alarms, round(p, 6) AS rate, round(greatest(0.0, {_P.format("-")}), 6) AS low, round(least(1.0, {_P.format("+")}), 6) AS high FROM rt"""


def time_drift(spark, sf_dir):
    return _round(drift.time_drift(behaviour._scores(spark, sf_dir), len(behaviour.PLAIN)), "rate")


QUERIES["time_drift"] = time_drift
ORACLE_SQL["time_drift"] = f"""WITH {behaviour._scores_sql()},
b AS (SELECT trace_id, CAST(greatest(0, floor((row_number() OVER (ORDER BY trace_id) - 1) * 5 / count(*) OVER ()) - 1) AS INT) AS block FROM big),
t AS (SELECT lens, list_sort(list(score))[CAST(ceil((1 - 0.05 / {len(behaviour.PLAIN)}) * (count(*) - 1)) AS INT) + 1] AS tau FROM sc JOIN b USING (trace_id) WHERE block = 0 GROUP BY lens),
h AS (SELECT block, trace_id, max(CAST(score > tau AS INT)) AS alarm FROM sc JOIN b USING (trace_id) JOIN t USING (lens) WHERE block > 0 GROUP BY 1, 2)
SELECT block, count(*) AS n, CAST(sum(alarm) AS BIGINT) AS alarms, round(sum(alarm) / count(*), 6) AS rate FROM h GROUP BY block"""


def ablation(spark, sf_dir):
    return drift.ablation(behaviour._scores(spark, sf_dir), behaviour.PLAIN, "books")


QUERIES["ablation"] = ablation
_N = len(behaviour.PLAIN)
ORACLE_SQL["ablation"] = f"""WITH {behaviour._scores_sql()}{behaviour._CAL}, v AS (SELECT * FROM (VALUES ('full', {_N}, ''), ('without books', {_N - 1}, 'books')) x(variant, m, gone)),
t AS (SELECT variant, lens, list_sort(list(score))[CAST(ceil((1 - 0.05 / m) * (count(*) - 1)) AS INT) + 1] AS tau FROM sc JOIN pt USING (trace_id), v WHERE part = 'cal' AND lens <> gone GROUP BY variant, m, lens)
SELECT variant, sc.trace_id, max(CAST(score > tau AS INT)) AS detected FROM sc JOIN pt USING (trace_id) JOIN t USING (lens) WHERE part = 'val' GROUP BY variant, sc.trace_id"""


def _synthetic(spark):
    traces = tables.written(attacks.synthetic(spark, 60, hours=2.0))
    s = stack.scores(lenses.series(traces, lenses.Profile(), _FAST), traces, _FAST)
    return traces, lenses.Profile(), tables.written(stack.calibrate(s.where("trace_id < 40"), len(_FAST)))


def library_coverage(spark, sf_dir):
    """Which known attacks the detectors notice on synthetic traces."""
    traces, prof, th = _synthetic(spark)
    specs = [attacks.Spec(k, p, t0=1800.0) for k, p in attacks.LIBRARY.items()]
    return attacks.bench(specs, traces.where("trace_id >= 40"), prof, _FAST, th).withColumn("fired", F.array_join("fired", ","))


QUERIES["library_coverage"] = library_coverage


def fuzz_escapes(spark, sf_dir):
    """Random harmful attacks that no detector notices."""
    traces, prof, th = _synthetic(spark)
    return attacks.fuzz(traces.where("trace_id >= 40"), prof, _FAST, th, n=40).where("NOT detected").withColumn("fired", F.array_join("fired", ","))


QUERIES["fuzz_escapes"] = fuzz_escapes


def staleness(spark, sf_dir):
    import numpy as np

    prof = lenses.Profile()
    return drift.staleness(spark, [("v0", prof), ("v1", drift.perturbed(prof, 0.5, np.random.default_rng(1)))], _FAST, 30, 10)


QUERIES["staleness"] = staleness


def simulated_updates(spark, sf_dir):
    """Pace of a simulated process that falls behind."""
    return _round(accounting.pacing(tables.written(accounting.simulated(spark, 30, 8, 3))), "span_days", "changes_per_day", "reviews_per_day", "growth_per_day", "lag_median_h", "lag_p95_h", "within_sla")


QUERIES["simulated_updates"] = simulated_updates
_DRAW = "(('0x' || substr(md5(id || ':0:{0}'), 1, 8))::UBIGINT / 4294967296.0)"
_SIMULATED = f"""
s0 AS (SELECT id, -ln(greatest({_DRAW.format("gap")}, 1e-12)) * 86400 / 8 AS gap, -ln(greatest({_DRAW.format("work")}, 1e-12)) * 86400 / 3 AS work FROM range(240) x(id)),
s1 AS (SELECT *, sum(gap) OVER (ORDER BY id) AS t, sum(work) OVER (ORDER BY id) AS done FROM s0), s2 AS (SELECT id, t, done + max(t - done + work) OVER (ORDER BY id) AS r FROM s1),
chg AS (SELECT t, CASE WHEN r <= 2592000.0 THEN r END AS review_t FROM s2 WHERE t <= 2592000.0), rec AS (SELECT t + 30 AS t FROM chg UNION ALL SELECT review_t FROM chg WHERE review_t IS NOT NULL)"""
ORACLE_SQL["simulated_updates"] = accounts.ORACLE_SQL["pacing"].replace(accounts.REVIEWS, _SIMULATED)


def exported_events(spark, sf_dir):
    return files.exported(views.chunks(spark, sf_dir)).drop("value")


QUERIES["exported_events"] = exported_events
ORACLE_SQL["exported_events"] = f"""WITH {behaviour.CHUNKS} SELECT trace_id, round_even(t, 3) AS t, agent, chan, (['read', 'write', 'bash', 'search', 'test', 'net'])[kind + 1] AS kind, round_even(size, 1) AS size,
  CASE WHEN target < 7 THEN (['AGENTS.md', 'CLAUDE.md', '.claude/settings.json', '.cursor/rules', '.gemini/settings.json', '.vscode/tasks.json', '.github/workflows'])[target + 1]
       WHEN kind = 5 THEN 'host-' || target || '.example' WHEN kind IN (2, 4) THEN 'cmd-' || target ELSE 'src/file_' || target || '.py' END AS target FROM r"""


def lineage(spark, sf_dir):
    """A signature embedded into the embeddings as one vector, and recovered."""
    v = views.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("chunk"), "vec_id", "embedding")
    v = v.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"].cast("array<double>"))).alias("v"))
    sig = weights.signature(4, 1)
    signed = weights.embed(v, b"key", sig)
    rows = [(n, r["agree"], r["n_bits"], r["lineage"]) for n, r in (("signed", weights.verify(signed, b"key", sig)), ("other key", weights.verify(signed, b"other", sig)))]
    return spark.createDataFrame(rows, "vector string, agree int, n_bits int, lineage string")


QUERIES["lineage"] = lineage
