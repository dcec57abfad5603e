"""Queries on behaviour: events, chunks, detectors, profiles and calibrated alarms."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.functions import scalars
from watchgrid.operators import lenses, profile, stack
from watchgrid.sources import tables, views

PROFILE = replace(model.DEFAULT_PROFILE, win=views.WINDOW)
PLAIN = tuple(n for n in lenses.DEFAULT if n not in ("clock", "digits", "coupling"))

# ------------------------------------------------------------------------- SQL

EVENTS = """
ev AS (
  SELECT event_id AS seq, epoch(ts) AS t, CAST(user_id % 4 AS INT) AS agent,
    CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE CASE WHEN event_id % 2 = 0 THEN 2 ELSE 4 END END AS kind,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, value AS v
  FROM events),
rep0 AS (
  SELECT seq, t, agent, kind, CASE WHEN kind = 1 AND k < 10 THEN k % 7 ELSE 7 + k END AS target, v * 100 AS size, CASE WHEN kind = 4 THEN round_even(v, 1) END AS value FROM ev),
tr AS (
  SELECT *, 0 AS chan FROM rep0
  UNION ALL SELECT seq, t + 0.25, agent, kind, target, size, value, 1 FROM rep0 WHERE seq % 50 <> 0
  UNION ALL SELECT seq, t + 5.0, agent, kind, target, size, value, 1 FROM rep0 WHERE seq % 97 = 0)
"""
CHUNKS = (
    EVENTS
    + """,
st AS (SELECT min(t) AS t0 FROM tr WHERE chan = 0),
c0 AS (SELECT seq, t - t0 - floor((t - t0) / 43200.0) * 43200.0 AS t, agent, kind, target, size, value, chan, CAST(floor((t - t0) / 43200.0) AS BIGINT) AS trace_id FROM tr, st WHERE t >= t0),
big AS (SELECT trace_id FROM c0 WHERE chan = 0 GROUP BY trace_id HAVING count(*) >= 100),
ch AS (SELECT * FROM c0 WHERE trace_id IN (SELECT trace_id FROM big)),
r AS (SELECT * FROM ch WHERE chan = 0)
"""
)
_TRANS = ", ".join(f"({i}, {j}, CAST('{p!r}' AS DOUBLE))" for i, row in enumerate(PROFILE.trans) for j, p in enumerate(row))
W = views.WINDOW


def _chain(steps: list[int]) -> str:
    """The nested windows of an ordered pattern."""
    over = "OVER (PARTITION BY trace_id ORDER BY t DESC, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sql = f"SELECT trace_id, seq, t, tok, CASE WHEN tok = {steps[-1]} THEN t END AS e FROM (SELECT *, CASE WHEN kind = 1 AND target < 7 THEN 6 ELSE kind END AS tok FROM r)"
    for s in reversed(steps[:-1]):
        sql = f"SELECT trace_id, seq, t, tok, CASE WHEN tok = {s} THEN x END AS e FROM (SELECT *, last_value(e IGNORE NULLS) {over} AS x FROM ({sql}))"
    return f"SELECT trace_id, e AS ts, greatest(0, ln(3600.0 / (e - t + 1.0))) AS score FROM ({sql}) WHERE e IS NOT NULL"


SERIES = {
    "burst": "SELECT trace_id, (floor(t / 10) + 1) * 10 AS ts, count(*) AS score FROM r GROUP BY trace_id, floor(t / 10)",
    "sweep": f"SELECT trace_id, max(t) AS ts, count(DISTINCT target) AS score FROM r GROUP BY trace_id, floor(t / {W}) HAVING count(*) >= 10",
    "ctrl": f"SELECT trace_id, (floor(t / {W}) + 1) * {W} AS ts, count(*) AS score FROM r WHERE kind = 1 AND target < 7 GROUP BY trace_id, floor(t / {W})",
    "netvol": f"SELECT trace_id, (floor(t / {W}) + 1) * {W} AS ts, sum(size) AS score FROM r WHERE kind = 5 GROUP BY trace_id, floor(t / {W})",
    "rhythm": f"""SELECT trace_id, max(t) AS ts, 1.0 / (stddev_pop(gap) / (avg(gap) + 1e-9) + 0.05) AS score
      FROM (SELECT *, floor(t / {W}) AS b, t - lag(t) OVER (PARTITION BY trace_id, floor(t / {W}) ORDER BY t, seq) AS gap FROM r) GROUP BY trace_id, b HAVING count(*) >= 15""",
    "surprisal": f"""SELECT x.trace_id, max(t) AS ts, avg(-ln(m.p)) AS score
      FROM (SELECT *, floor(t / {W}) AS b, lead(kind) OVER (PARTITION BY trace_id, floor(t / {W}) ORDER BY t, seq) AS nk FROM r) x LEFT JOIN (VALUES {_TRANS}) m(i, j, p) ON x.kind = m.i AND x.nk = m.j
      GROUP BY x.trace_id, b HAVING count(*) >= 15""",
    "books": f"""SELECT trace_id, (floor(t / {W}) + 1) * {W} AS ts, count(*) AS score
      FROM (SELECT a.trace_id, a.t FROM ch a WHERE a.trace_id IN (SELECT trace_id FROM ch WHERE chan = 1)
            AND NOT EXISTS (SELECT 1 FROM ch b WHERE b.trace_id = a.trace_id AND b.kind = a.kind AND b.chan = 1 - a.chan AND abs(a.t - b.t) <= 2.0)) GROUP BY trace_id, floor(t / {W})""",
    **{n: _chain([model.TOKENS[x] for x in t]) for n, t in model.TEMPLATES.items()},
    "coupling": f"""SELECT e.trace_id, e.ts, CASE WHEN e.edges >= 8 AND s.sends >= 3 THEN coalesce(s.x, 0.0) ELSE 0.0 END AS score
      FROM (SELECT trace_id, floor(t / {W}) AS b, count(*) AS n, min(t) AS t0, max(t) AS ts, CAST(ceil((max(t) + 5.0 - min(t)) / 5.0) AS BIGINT) AS edges FROM r GROUP BY trace_id, floor(t / {W}) HAVING count(*) >= 20) e
      LEFT JOIN (
        SELECT trace_id, b, max(CASE WHEN va > 0 AND vb > 0 THEN abs(c) / sqrt(va * vb) END) AS x, max(CASE WHEN lag = 0 THEN sb END) AS sends
        FROM (SELECT trace_id, b, lag, sum(ra) AS sa, sum(nb) AS sb, count(*) * sum(ra * ra) - sum(ra) * sum(ra) AS va, count(*) * sum(nb * nb) - sum(nb) * sum(nb) AS vb, count(*) * sum(ra * nb) - sum(ra) * sum(nb) AS c
              FROM (SELECT g.trace_id, g.b, g.lag, g.p, coalesce(x.a, 0) AS ra, coalesce(y.n, 0) AS nb
                    FROM (SELECT trace_id, b, lag, unnest(range(0, edges - 1 - lag)) AS p FROM cw, (VALUES (0), (1), (2)) l(lag)) g
                    LEFT JOIN slots x ON x.trace_id = g.trace_id AND x.b = g.b AND x.slot = g.p LEFT JOIN slots y ON y.trace_id = g.trace_id AND y.b = g.b AND y.slot = g.p + g.lag)
              GROUP BY trace_id, b, lag) GROUP BY trace_id, b) s ON s.trace_id = e.trace_id AND s.b = e.b""",
}
_SLOTS = f""",
cw AS (SELECT trace_id, floor(t / {W}) AS b, min(t) AS t0, CAST(ceil((max(t) + 5.0 - min(t)) / 5.0) AS BIGINT) AS edges FROM r GROUP BY trace_id, floor(t / {W}) HAVING count(*) >= 20),
slots AS (SELECT r.trace_id, cw.b, CAST(least(floor((r.t - cw.t0) / 5.0), cw.edges - 2) AS BIGINT) AS slot, CAST(sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN kind = 5 THEN 1 ELSE 0 END) AS DOUBLE) AS n
          FROM r JOIN cw ON r.trace_id = cw.trace_id AND floor(r.t / {W}) = cw.b WHERE kind IN (0, 5) GROUP BY 1, 2, 3)
"""


def _scores_sql(names=PLAIN) -> str:
    every = " UNION ALL ".join(f"SELECT '{n}' AS lens, trace_id, ts, CAST(score AS DOUBLE) AS score FROM ({SERIES[n]})" for n in names)
    return (
        f"{CHUNKS}, sr AS ({every}),\nls AS (SELECT unnest({list(names)!r}) AS lens),\n"
        "sc AS (SELECT big.trace_id, ls.lens, coalesce(max(sr.score), 0.0) AS score FROM big CROSS JOIN ls LEFT JOIN sr ON sr.trace_id = big.trace_id AND sr.lens = ls.lens GROUP BY big.trace_id, ls.lens)"
    )


_CAL = """,
pt AS (SELECT trace_id, CASE WHEN row_number() OVER (ORDER BY trace_id) <= floor(count(*) OVER () * 0.6) THEN 'cal' ELSE 'val' END AS part FROM big),
th AS (SELECT lens, list_sort(list(score))[CAST(ceil((1 - 0.05 / %d) * (count(*) - 1)) AS INT) + 1] AS tau, quantile_cont(score, 0.5) AS med, stddev_pop(score) AS sd FROM sc JOIN pt USING (trace_id) WHERE part = 'cal' GROUP BY lens)
""" % len(PLAIN)

QUERIES, ORACLE_SQL = {}, {}


def _round(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) + 0.0 for n in names})


def _lens_query(name):
    def query(spark, sf_dir):
        out = lenses.LENSES[name](views.chunks(spark, sf_dir), PROFILE)
        return _round(out, "ts", "score", places=5)

    return query


for _n in lenses.DEFAULT:
    QUERIES[f"lens_{_n}"] = _lens_query(_n)
    if _n in SERIES:
        ORACLE_SQL[f"lens_{_n}"] = f"WITH {CHUNKS}{_SLOTS if _n == 'coupling' else ''} SELECT trace_id, round(ts, 5) AS ts, round(CAST(score AS DOUBLE), 5) AS score FROM ({SERIES[_n]})"


def trace_events(spark, sf_dir):
    return _round(views.chunks(spark, sf_dir).drop("value"), "t", "size")


QUERIES["trace_events"] = trace_events
ORACLE_SQL["trace_events"] = f"WITH {CHUNKS} SELECT trace_id, seq, round(t, 6) AS t, agent, kind, target, round(size, 6) AS size, chan FROM ch"


def _chunked(spark, sf_dir, names=PLAIN, least=views.LEAST_EVENTS):
    """The chunks, and their ids as a small table. The chunks are a table of each record, of the columns that the detectors `names` read: only `books` reads the independent record, and of
    it kinds and times."""
    trace = profile.cut(views.raw_trace(spark, sf_dir), views.CHUNK)
    reported = tables.written(trace.where("chan = 0").select(*[c for c in trace.columns if c not in ("agent", "chan") and (c != "value" or "digits" in names)]))
    enough = tables.small(profile.large(reported, least))
    recorded = tables.written(trace.where("chan = 1").select("trace_id", "t", "kind").join(enough, "trace_id", "left_semi"))
    return reported.join(enough, "trace_id", "left_semi").withColumn("chan", F.lit(0)).unionByName(recorded.withColumn("chan", F.lit(1)), allowMissingColumns=True), enough


def _chunks(spark, sf_dir, names=PLAIN, least=views.LEAST_EVENTS):
    return _chunked(spark, sf_dir, names, least)[0]


def _scores(spark, sf_dir, least=views.LEAST_EVENTS):
    trace, ids = _chunked(spark, sf_dir, least=least)
    return tables.written(stack.scores(lenses.series(trace, PROFILE, PLAIN), ids, PLAIN))


def lens_scores(spark, sf_dir, least=views.LEAST_EVENTS):
    """Alarm score of every chunk by every detector that is plain SQL."""
    return _round(_scores(spark, sf_dir, least), "score")


QUERIES["lens_scores"] = lens_scores
ORACLE_SQL["lens_scores"] = f"WITH {_scores_sql()} SELECT trace_id, lens, round(score, 6) AS score FROM sc"


def _series(spark, sf_dir):
    """The ids of the chunks, and what the plain detectors say of them, as tables."""
    trace, ids = _chunked(spark, sf_dir)
    return ids, tables.written(lenses.series(trace, PROFILE, PLAIN))


def _calibrated(spark, sf_dir, scores=None):
    s = _scores(spark, sf_dir) if scores is None else scores
    parts = stack.split_chronological(s)
    return s.join(parts, "trace_id"), len(PLAIN)


def stack_calibration(spark, sf_dir):
    s, n = _calibrated(spark, sf_dir)
    return _round(stack.calibrate(s.where("part = 'cal'"), n), "tau", "med", "scale")


QUERIES["stack_calibration"] = stack_calibration
ORACLE_SQL["stack_calibration"] = f"WITH {_scores_sql()}{_CAL} SELECT lens, round(tau, 6) AS tau, round(med, 6) AS med, round(greatest(tau - med, 0.1 * sd, 1e-6), 6) AS scale FROM th"


def stack_margins(spark, sf_dir):
    s, n = _calibrated(spark, sf_dir)
    return _round(stack.margins(s.where("part = 'val'"), stack.calibrate(s.where("part = 'cal'"), n)), "norm")


QUERIES["stack_margins"] = stack_margins
ORACLE_SQL["stack_margins"] = f"WITH {_scores_sql()}{_CAL} SELECT sc.trace_id, sc.lens, round(greatest(0.0, least(20.0, (score - med) / greatest(tau - med, 0.1 * sd, 1e-6))), 6) AS norm FROM sc JOIN pt USING (trace_id) JOIN th USING (lens) WHERE part = 'val'"


def _alarms(spark, sf_dir, found=None):
    ids, series = found or _series(spark, sf_dir)
    s = stack.scores(series, ids, PLAIN).join(stack.split_chronological(ids), "trace_id")
    th = stack.calibrate(s.where("part = 'cal'"), len(PLAIN))
    val = s.where("part = 'val'").select("trace_id").distinct()
    return stack.evaluate(series.join(val, "trace_id", "left_semi"), val, th, PLAIN)


def stack_alarms(spark, sf_dir):
    e = _alarms(spark, sf_dir)
    return _round(e.select("trace_id", "detected", "first", F.array_join("fired", ",").alias("fired"), F.col("n_fired").cast("long").alias("n_fired")), "first")


QUERIES["stack_alarms"] = stack_alarms
ORACLE_SQL["stack_alarms"] = f"""WITH {_scores_sql()}{_CAL},
h AS (SELECT sr.trace_id, sr.lens, sr.ts FROM sr JOIN th USING (lens) JOIN pt USING (trace_id) WHERE part = 'val' AND score > tau)
SELECT pt.trace_id, count(h.ts) > 0 AS detected, round(min(h.ts), 6) AS first, coalesce(string_agg(DISTINCT h.lens, ',' ORDER BY h.lens), '') AS fired, count(DISTINCT h.lens) AS n_fired
FROM pt LEFT JOIN h USING (trace_id) WHERE part = 'val' GROUP BY pt.trace_id"""


def full_stack_alarms(spark, sf_dir):
    """Alarms of all 13 detectors on the later chunks, calibrated on the first ones."""
    (trace, ids), names = _chunked(spark, sf_dir, lenses.DEFAULT), lenses.DEFAULT
    series = tables.written(lenses.series(trace, PROFILE, names))
    s = stack.scores(series, ids, names).join(stack.split_chronological(ids), "trace_id")
    th = tables.written(stack.calibrate(s.where("part = 'cal'"), len(names)))
    val = s.where("part = 'val'").select("trace_id").distinct()
    e = stack.evaluate(series.join(val, "trace_id", "left_semi"), val, th, names)
    return _round(e.select("trace_id", "detected", "first", F.array_join("fired", ",").alias("fired"), F.col("n_fired").cast("long").alias("n_fired")), "first")


QUERIES["full_stack_alarms"] = full_stack_alarms


def kind_divergence(spark, sf_dir):
    """How far the shares of kinds in even and in odd chunks lie apart, in bits."""
    n = views.chunks(spark, sf_dir).where("chan = 0").groupBy(F.col("kind")).agg(F.sum((F.col("trace_id") % 2 == 0).cast("double")).alias("p"), F.sum((F.col("trace_id") % 2).cast("double")).alias("q"))
    both = n.agg(F.array_sort(F.collect_list(F.struct("kind", "p", "q"))).alias("x"))  # six kinds
    return _round(both.select(scalars.jsd(F.transform("x", lambda r: r["p"]), F.transform("x", lambda r: r["q"])).alias("bits")), "bits", places=9)


QUERIES["kind_divergence"] = kind_divergence
ORACLE_SQL["kind_divergence"] = f"""WITH {CHUNKS}, n AS (SELECT kind, sum(CASE WHEN trace_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS p, sum(CASE WHEN trace_id % 2 = 1 THEN 1.0 ELSE 0.0 END) AS q FROM r GROUP BY kind),
s AS (SELECT (p + 1e-12) / sum(p + 1e-12) OVER () AS p, (q + 1e-12) / sum(q + 1e-12) OVER () AS q FROM n)
SELECT round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 9) AS bits FROM s"""


def spot_checks(spark, sf_dir):
    """Probability that k spot checks of a part's lot find at least one fault, and the harm of some attacks on it."""
    p = views.table(spark, sf_dir, "part")
    harm = F.create_map(F.lit("exfil"), F.col("p_retailprice") * 100, F.lit("loop"), F.col("p_size").cast("double"), F.lit("ctrl"), (F.col("p_partkey") % 3).cast("double"))
    return _round(p.select("p_partkey", scalars.spotcheck_detect(F.col("p_size") / 100, F.col("p_partkey") % 20).alias("found"), scalars.harm_score(harm).alias("harm")), "found", "harm")


QUERIES["spot_checks"] = spot_checks
ORACLE_SQL["spot_checks"] = "SELECT p_partkey, round(1 - pow(1 - p_size / 100, p_partkey % 20), 6) + 0.0 AS found, round(p_retailprice * 100 / 1e5 + p_size / 50.0 + (p_partkey % 3) / 0.2, 6) + 0.0 AS harm FROM part"


def false_alarm_rate(spark, sf_dir):
    return _round(stack.false_alarm_rate(_alarms(spark, sf_dir)), "rate")


QUERIES["false_alarm_rate"] = false_alarm_rate
ORACLE_SQL["false_alarm_rate"] = f"SELECT round(avg(CAST(detected AS INT)), 6) AS rate FROM ({ORACLE_SQL['stack_alarms']})"


def digit_statistics(spark, sf_dir):
    return _round(lenses.digit_statistics(views.raw_trace(spark, sf_dir)), "ts", "var", "chi10", "chi7", "chi12")


QUERIES["digit_statistics"] = digit_statistics
ORACLE_SQL["digit_statistics"] = f"""WITH {EVENTS},
v AS (SELECT t, value, row_number() OVER (ORDER BY t, seq) - 1 AS i, count(*) OVER () AS n, CAST(round_even(value * 10, 0) AS BIGINT) AS c FROM tr WHERE chan = 0 AND value IS NOT NULL),
b AS (SELECT *, unnest(range(CAST(greatest(0, floor((i - 60) / 30.0) + 1) AS BIGINT), CAST(least(floor(i / 30.0), floor((n - 60) / 30.0)) AS BIGINT) + 1)) AS block FROM v WHERE n >= 60),
d AS (SELECT block, base, c % base AS d, count(*) AS m FROM b, (VALUES (10), (7), (12)) x(base) GROUP BY 1, 2, 3),
x AS (SELECT block, base, sum(m * m) * base / 60.0 - 60.0 AS chi FROM d GROUP BY block, base)
SELECT CAST(0 AS BIGINT) AS trace_id, block, round(max(t), 6) AS ts, round(var_pop(value), 6) AS var, round((SELECT chi FROM x WHERE x.block = b.block AND base = 10), 6) AS chi10,
  round((SELECT chi FROM x WHERE x.block = b.block AND base = 7), 6) AS chi7, round((SELECT chi FROM x WHERE x.block = b.block AND base = 12), 6) AS chi12 FROM b GROUP BY block"""


def profile_statistics(spark, sf_dir):
    out = profile.statistics(views.chunks(spark, sf_dir))
    return _round(out, *[c for c in out.columns if c not in ("trace_id", "n")])


QUERIES["profile_statistics"] = profile_statistics
ORACLE_SQL["profile_statistics"] = f"""WITH {CHUNKS},
g AS (SELECT *, t - lag(t) OVER (PARTITION BY trace_id ORDER BY t, seq) AS gap, lag(value) OVER (PARTITION BY trace_id, value IS NULL ORDER BY t, seq) AS before FROM r),
s AS (SELECT trace_id, count(*) AS n, coalesce(sum(gap) FILTER (gap < 300), 0.0) AS act, max(t) - min(t) AS span, avg(CASE WHEN kind = 1 THEN CAST(target < 7 AS INT) END) AS cp,
  count(*) FILTER (size > 0 AND kind <> 5) AS nq, avg(ln(size)) FILTER (size > 0 AND kind <> 5) AS mq, stddev_pop(ln(size)) FILTER (size > 0 AND kind <> 5) AS sq,
  count(*) FILTER (size > 0 AND kind = 5) AS nn, avg(ln(size)) FILTER (size > 0 AND kind = 5) AS mn, count(value) AS nv, avg(value) AS mv, stddev_pop(value) AS sv, corr(before, value) AS rho,
  {", ".join(f"(sum(CAST(kind = {i} AS INT)) + 1) / (count(*) + 6) AS p{i}" for i in range(6))} FROM g GROUP BY trace_id)
SELECT trace_id, n, round(n / greatest(act, 1.0), 6) AS rate, round(greatest(0.02, least(0.95, act / greatest(span, 1.0))), 6) AS active_frac, round(greatest(coalesce(cp, 0.0), 1e-4), 6) AS ctrl_p,
  round(CASE WHEN nq > 5 THEN mq ELSE 6.0 END, 6) AS size_mu, round(CASE WHEN nq > 5 THEN sq ELSE 1.0 END, 6) AS size_sd, round(CASE WHEN nn > 5 THEN mn ELSE 8.0 END, 6) AS net_mu,
  round(CASE WHEN nv > 10 THEN mv ELSE 85.0 END, 6) AS value_mu, round(CASE WHEN nv > 10 THEN greatest(sv, 1e-3) ELSE 6.0 END, 6) AS value_sd, round(greatest(120.0, least(1800.0, 40.0 / (n / greatest(act, 1.0)))), 6) AS win,
  round(CASE WHEN nv < 30 OR sv < 1e-9 THEN 0.0 ELSE greatest(0.0, least(0.95, coalesce(CASE WHEN isnan(rho) THEN 0.0 ELSE rho END, 0.0))) END, 6) AS value_rho, {", ".join(f"round(p{i}, 6) AS p{i}" for i in range(6))} FROM s"""


def profile_transitions(spark, sf_dir):
    return _round(profile.transitions(views.chunks(spark, sf_dir).where("chan = 0")), "p", places=9)


QUERIES["profile_transitions"] = profile_transitions
ORACLE_SQL["profile_transitions"] = f"""WITH {CHUNKS},
b AS (SELECT kind, lead(kind) OVER (PARTITION BY trace_id ORDER BY t, seq) AS nk FROM r),
c AS (SELECT i.i AS kind, j.i AS next, 1.0 + (SELECT count(*) FROM b WHERE b.kind = i.i AND b.nk = j.i) AS n FROM range(6) i(i), range(6) j(i))
SELECT CAST(kind AS INT) AS kind, CAST(next AS INT) AS next, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind), 9) AS p FROM c"""


def compressed_gaps(spark, sf_dir):
    return profile.compressed(views.chunks(spark, sf_dir).where("chan = 0"), 60.0).select("trace_id", "seq", F.round("t", 4).alias("t"))


QUERIES["compressed_gaps"] = compressed_gaps
ORACLE_SQL["compressed_gaps"] = f"""WITH {CHUNKS}, g AS (SELECT trace_id, seq, t, least(coalesce(t - lag(t) OVER (PARTITION BY trace_id ORDER BY t, seq), 0.0), 60.0) AS g FROM r)
SELECT trace_id, seq, round(sum(g) OVER (PARTITION BY trace_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 4) AS t FROM g"""


def scale_statistics(spark, sf_dir):
    return _round(profile.scale_statistics(views.chunks(spark, sf_dir)), "p99_burst", "p99_net", "gap_med", "rare_p")


QUERIES["scale_statistics"] = scale_statistics
ORACLE_SQL["scale_statistics"] = f"""WITH {CHUNKS},
e AS (SELECT trace_id, unnest(range(0, CAST(max(floor(t / 10)) AS BIGINT) + 1)) AS b FROM r GROUP BY trace_id),
n AS (SELECT e.trace_id, e.b, count(r.t) AS n FROM e LEFT JOIN r ON r.trace_id = e.trace_id AND floor(r.t / 10) = e.b GROUP BY 1, 2),
g AS (SELECT t - lag(t) OVER (PARTITION BY trace_id ORDER BY t, seq) AS g FROM r),
p AS ({ORACLE_SQL["profile_transitions"].replace("round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind), 9)", "CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind)")}),
m AS (SELECT * FROM p WHERE kind <> next ORDER BY p, kind, next LIMIT 1)
SELECT round((SELECT quantile_cont(n, 0.99) FROM n), 6) AS p99_burst, round((SELECT quantile_cont(size, 0.99) FROM r WHERE kind = 5), 6) AS p99_net, round((SELECT quantile_cont(g, 0.5) FROM g WHERE g > 0), 6) AS gap_med,
  round(m.p, 6) AS rare_p, m.kind AS rare_a, m.next AS rare_b FROM m"""


def control_hints(spark, sf_dir):
    """Control classes and file buckets of names made from part names."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/src/"), F.when(F.col("p_partkey") % 5 == 0, ".claude/").when(F.col("p_partkey") % 7 == 0, "CLAUDE.md").otherwise("x/"), F.col("p_name")).alias("path"))
    return p.select("p_partkey", scalars.control_class(F.col("path")).alias("control"), scalars.file_bucket(F.col("path")).alias("bucket"))


QUERIES["control_hints"] = control_hints
_CASE = " ".join(f"WHEN contains(lower(path), '{h}') THEN {i}" for h, i in model.CONTROL_HINTS)
ORACLE_SQL["control_hints"] = f"""WITH p AS (SELECT p_partkey, '/src/' || CASE WHEN p_partkey % 5 = 0 THEN '.claude/' WHEN p_partkey % 7 = 0 THEN 'CLAUDE.md' ELSE 'x/' END || p_name AS path FROM part)
SELECT p_partkey, CASE {_CASE} ELSE -1 END AS control, CAST(('0x' || md5(path))::UHUGEINT % 300 + 7 AS INT) AS bucket FROM p"""
