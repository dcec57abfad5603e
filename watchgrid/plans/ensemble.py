"""Queries on ensembles of monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.operators import accounting, detection, gate, stack
from watchgrid.plans import behaviour
from watchgrid.plans.behaviour import _round
from watchgrid.sources import tables, views

QUERIES, ORACLE_SQL = {}, {}


def _table(spark, sf_dir, scores=None):
    """Which detectors score a chunk above their median: a rich detection table."""
    s, n = behaviour._calibrated(spark, sf_dir, scores)
    th = stack.calibrate(s.where("part = 'cal'"), n)
    return tables.written(s.join(F.broadcast(th), "lens").select(F.col("trace_id").alias("item"), F.col("lens").alias("monitor"), (F.col("score") > F.col("med")).cast("int").alias("detected")))


_DM = f"{behaviour._scores_sql()}{behaviour._CAL}, dm AS (SELECT trace_id AS item, lens AS monitor, CAST(score > med AS INT) AS detected FROM sc JOIN th USING (lens)), it AS (SELECT item, sum(detected) AS f, count(*) AS n FROM dm GROUP BY item)"


def detection_matrix(spark, sf_dir):
    return _table(spark, sf_dir)


QUERIES["detection_matrix"] = detection_matrix
ORACLE_SQL["detection_matrix"] = f"WITH {_DM} SELECT item, monitor, detected FROM dm"


def monitor_rates(spark, sf_dir):
    return _round(detection.rates(_table(spark, sf_dir)), "rate", "low", "high")


QUERIES["monitor_rates"] = monitor_rates
ORACLE_SQL["monitor_rates"] = f"""WITH {_DM}, g AS (SELECT monitor, CAST(sum(detected) AS BIGINT) AS k, count(*) AS n, sum(detected) / count(*) AS p FROM dm GROUP BY monitor)
SELECT monitor, k, n, round(p, 6) AS rate, round(greatest(0.0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1.0, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM g"""


def ensemble_caught(spark, sf_dir):
    return detection.ensemble(_table(spark, sf_dir))


QUERIES["ensemble_caught"] = ensemble_caught
ORACLE_SQL["ensemble_caught"] = f"WITH {_DM} SELECT item, CAST(f > 0 AS INT) AS caught FROM it"


def obstruction_rate(spark, sf_dir):
    return _round(detection.obstruction_rate(_table(spark, sf_dir)), "obstruction")


QUERIES["obstruction_rate"] = obstruction_rate
ORACLE_SQL["obstruction_rate"] = f"WITH {_DM} SELECT round(avg(CAST(f < n AS INT)), 6) AS obstruction FROM it WHERE f > 0"


def monitor_correlations(spark, sf_dir):
    return _round(detection.correlations(_table(spark, sf_dir)), "corr")


QUERIES["monitor_correlations"] = monitor_correlations
_NAN = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
ORACLE_SQL["monitor_correlations"] = f"""WITH {_DM} SELECT a.monitor AS a, b.monitor AS b, min(CAST(a.detected = b.detected AS INT)) AS same, round({_NAN.format("corr(CAST(a.detected AS DOUBLE), CAST(b.detected AS DOUBLE))")}, 6) + 0.0 AS corr
FROM dm a JOIN dm b ON a.item = b.item AND a.monitor < b.monitor GROUP BY 1, 2"""


def failure_correlation(spark, sf_dir):
    return _round(detection.failure_correlation(_table(spark, sf_dir)), "failure_correlation")


QUERIES["failure_correlation"] = failure_correlation
ORACLE_SQL["failure_correlation"] = f"""WITH {_DM}, m AS (SELECT item, monitor, CAST(1 - detected AS DOUBLE) AS d FROM dm WHERE item IN (SELECT item FROM it WHERE f > 0)),
v AS (SELECT monitor FROM m GROUP BY monitor HAVING stddev_pop(d) > 0), mv AS (SELECT * FROM m WHERE monitor IN (SELECT monitor FROM v))
SELECT round(avg(c), 6) AS failure_correlation FROM (SELECT corr(a.d, b.d) AS c FROM mv a JOIN mv b ON a.item = b.item AND a.monitor < b.monitor GROUP BY a.monitor, b.monitor)"""


def effective_rank(spark, sf_dir):
    return _round(detection.effective_rank(behaviour._scores(spark, sf_dir), "trace_id", "lens", "score"), "effective_rank")


QUERIES["effective_rank"] = effective_rank
ORACLE_SQL["effective_rank"] = f"""WITH {behaviour._scores_sql()}, g AS (SELECT a.lens AS a, b.lens AS b, sum(a.score * b.score) AS g FROM sc a JOIN sc b USING (trace_id) GROUP BY 1, 2),
n AS (SELECT g.a, g.b, CASE WHEN x.g > 0 AND y.g > 0 THEN g.g / (sqrt(x.g) * sqrt(y.g)) ELSE 0 END AS x FROM g JOIN g x ON x.a = g.a AND x.b = g.a JOIN g y ON y.a = g.b AND y.b = g.b)
SELECT round(pow(sum(CASE WHEN a = b THEN x END), 2) / sum(x * x), 6) AS effective_rank FROM n"""


def redundancy(spark, sf_dir):
    """Greedy order, groups and plateau of the detectors, as rows."""
    fired = detection.Fired.of(_table(spark, sf_dir), list(behaviour.PLAIN))
    rows = [("order", i, n, float(g)) for i, (n, g) in enumerate(fired.order())] + [("group", i, "+".join(g), float(len(g))) for i, g in enumerate(fired.groups())]
    rows += [("plateau", m, "", s) for m, s in fired.plateau()] + [("without", 0, n, c) for n, c in fired.without_one().items()]
    return tables.local(spark, rows, "what string, place int, name string, value double")


QUERIES["redundancy"] = redundancy


def coverage_plateau(spark, sf_dir):
    """The exact expected coverage of m random monitors."""
    fired = detection.Fired.of(_table(spark, sf_dir), list(behaviour.PLAIN))
    return _round(tables.local(spark, fired.plateau(), "m int, share double"), "share")


QUERIES["coverage_plateau"] = coverage_plateau
_M = len(behaviour.PLAIN)
ORACLE_SQL["coverage_plateau"] = f"""WITH {_DM}, m AS (SELECT CAST(unnest(range(1, {_M + 1})) AS INT) AS m)
SELECT m.m, round(avg(1 - CASE WHEN {_M} - f < m.m THEN 0.0 ELSE exp(lgamma({_M} - f + 1) - lgamma({_M} - f - m.m + 1) - lgamma({_M + 1}) + lgamma({_M} - m.m + 1)) END), 6) AS share FROM it, m WHERE f > 0 GROUP BY m.m"""


def leave_one_out(spark, sf_dir):
    fired = detection.Fired.of(_table(spark, sf_dir), list(behaviour.PLAIN))
    return _round(tables.local(spark, list(fired.without_one().items()), "monitor string, coverage double"), "coverage")


QUERIES["leave_one_out"] = leave_one_out
ORACLE_SQL["leave_one_out"] = f"WITH {_DM} SELECT dm.monitor, round(avg(CAST(f - detected > 0 AS INT)), 6) AS coverage FROM dm JOIN it USING (item) WHERE f > 0 GROUP BY dm.monitor"


def strengths_caught(spark, sf_dir):
    """The smallest strength from which the items of a family are caught; families and strengths by the number of the chunk."""
    t = _table(spark, sf_dir)
    items = t.select("item").distinct().select("item", F.concat(F.lit("f"), F.col("item") % 3).alias("family"), F.pow(F.lit(2.0), F.col("item") % 4).alias("k"))
    return detection.smallest_caught(items, detection.ensemble(t.where(F.col("monitor").isin("burst", "books"))))


QUERIES["strengths_caught"] = strengths_caught
ORACLE_SQL["strengths_caught"] = f"""WITH {_DM}, c AS (SELECT item, max(detected) AS caught FROM dm WHERE monitor IN ('burst', 'books') GROUP BY item),
fk AS (SELECT concat('f', item % 3) AS family, pow(2.0, item % 4) AS k, avg(caught) AS rate FROM c GROUP BY 1, 2) SELECT family, min(CASE WHEN rate >= 0.8 THEN k END) AS k80 FROM fk GROUP BY family"""


def near_copies(spark, sf_dir):
    """The representative of every detector that ever fires; those that detect nearly alike share one."""
    rep, _ = detection.independent(_table(spark, sf_dir), 0.5)
    return tables.local(spark, sorted(rep.items()), "monitor string, representative string")


QUERIES["near_copies"] = near_copies
ORACLE_SQL["near_copies"] = f"""WITH RECURSIVE {_DM}, lv AS (SELECT DISTINCT monitor FROM dm WHERE detected = 1),
pr AS (SELECT a.monitor AS a, b.monitor AS b FROM dm a JOIN dm b ON a.item = b.item AND a.monitor <> b.monitor GROUP BY 1, 2
  HAVING bool_and(a.detected = b.detected) OR coalesce({_NAN.format("corr(CAST(a.detected AS DOUBLE), CAST(b.detected AS DOUBLE))")} >= 0.5, false)),
rc AS (SELECT monitor AS a, monitor AS c FROM lv UNION SELECT pr.b, rc.c FROM rc JOIN pr ON pr.a = rc.a JOIN lv ON lv.monitor = pr.b)
SELECT a AS monitor, min(c) AS representative FROM rc GROUP BY a"""


def gate_decision(spark, sf_dir):
    """The gate's criteria over the detection table, the later chunks' alarms and the accounts."""
    ids, series = behaviour._series(spark, sf_dir)  # scores and alarms are both of these
    table = _table(spark, sf_dir, tables.written(stack.scores(series, ids, behaviour.PLAIN)))
    late = tables.written(behaviour._alarms(spark, sf_dir, (ids, series)))
    names = F.array(*[F.lit(n) for n in behaviour.PLAIN])
    clean = late.select(F.col("trace_id").alias("item"), F.explode(names).alias("monitor"), "fired").select("item", "monitor", F.array_contains("fired", F.col("monitor")).cast("int").alias("detected"))
    records = tables.written(views.updates(spark, sf_dir))
    changes = tables.written(accounting.reviewed(records)[0])
    pace = accounting.assessed(records, changes=changes)
    found = gate.criteria(gate.Evidence(detections=table, clean=clean, findings=tables.written(accounting.reconcile(records, changes=changes)), pacing=pace))
    return gate.as_table(spark, [*found, gate.Criterion("decision", gate.decide(found))])


QUERIES["gate_decision"] = gate_decision
