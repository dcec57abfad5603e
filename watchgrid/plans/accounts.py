"""Queries on self-updates, ledgers and shared aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.operators import accounting, commons
from watchgrid.plans import behaviour
from watchgrid.sources import views

QUERIES, ORACLE_SQL = {}, {}

RECORDS = """
o0 AS (SELECT o_orderkey, o_custkey, o_orderstatus, epoch(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders),
o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS before FROM o0),
sh AS (SELECT l_orderkey, min(epoch(CAST(l_shipdate AS TIMESTAMP))) AS r FROM lineitem GROUP BY l_orderkey),
rec AS (
  SELECT 'change' AS type, t, CAST(o_custkey AS VARCHAR) AS artifact, CASE WHEN o_orderkey % 17 = 0 THEN 'x' || CAST(before AS VARCHAR) ELSE CAST(before AS VARCHAR) END AS old, CAST(o_orderkey AS VARCHAR) AS new,
    CAST(NULL AS VARCHAR) AS hash, CAST(NULL AS VARCHAR) AS result, 0 AS ord, o_orderkey AS seq FROM o
  UNION ALL SELECT 'snapshot', t + 30, CAST(o_custkey AS VARCHAR), NULL, NULL, h, NULL, 2, o_orderkey FROM (
    SELECT *, CASE WHEN o_orderkey % 23 = 0 THEN '-' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 29 = 0 THEN CAST(before AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS h FROM o) WHERE h IS NOT NULL
  UNION ALL SELECT 'review', greatest(r, t + 60), CAST(o_custkey AS VARCHAR), NULL, CASE WHEN o_orderkey % 31 = 0 THEN '?' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END, NULL,
    CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END, 1, o_orderkey FROM o JOIN sh ON o_orderkey = l_orderkey)
"""
REVIEWS = (
    RECORDS
    + """,
q1 AS (SELECT *, sum(CASE type WHEN 'change' THEN 1 ELSE -1 END) OVER (PARTITION BY artifact, new ORDER BY t, ord, seq ROWS UNBOUNDED PRECEDING) AS s FROM rec WHERE type <> 'snapshot'),
q2 AS (SELECT *, least(min(s) OVER (PARTITION BY artifact, new ORDER BY t, ord, seq ROWS UNBOUNDED PRECEDING), 0) AS low FROM q1),
q3 AS (SELECT *, type = 'review' AND low < coalesce(lag(low) OVER (PARTITION BY artifact, new ORDER BY t, ord, seq), 0) AS lost FROM q2),
q4 AS (SELECT *, row_number() OVER (PARTITION BY artifact, new, type ORDER BY t, ord, seq) AS j FROM q3 WHERE NOT lost),
chg AS (SELECT a.artifact, a.new, a.t, b.t AS review_t, b.result FROM q4 a LEFT JOIN q4 b ON b.type = 'review' AND a.artifact = b.artifact AND a.new = b.new AND a.j = b.j WHERE a.type = 'change')
"""
)
_RECONCILE = (
    "WITH RECURSIVE"
    + REVIEWS
    + """,
e AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY t, ord, seq) AS n FROM rec WHERE type <> 'review'),
f AS (SELECT e.*, type = 'snapshot' AND EXISTS (SELECT 1 FROM e c WHERE c.type = 'change' AND c.artifact = e.artifact AND c.new = e.hash AND c.t BETWEEN e.t AND e.t + 60) AS declared,
  coalesce((SELECT max(c.t) FROM e c WHERE c.type = 'change' AND c.artifact = e.artifact AND c.t <= e.t) >= e.t - 60, false) AS lagging FROM e),
w AS (
  SELECT artifact, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS known, CAST(NULL AS VARCHAR) AS prev, CAST(NULL AS VARCHAR) AS finding, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS VARCHAR) AS state FROM (SELECT DISTINCT artifact FROM e)
  UNION ALL
  SELECT f.artifact, f.n,
    CASE WHEN type = 'change' THEN new WHEN w.known IS NULL THEN hash WHEN hash = w.known OR declared OR (w.prev IS NOT NULL AND hash = w.prev AND lagging) THEN w.known ELSE hash END,
    CASE WHEN type = 'change' THEN w.known WHEN w.known IS NULL OR hash = w.known OR declared OR (w.prev IS NOT NULL AND hash = w.prev AND lagging) THEN w.prev ELSE w.known END,
    CASE WHEN type = 'change' THEN CASE WHEN w.known IS NOT NULL AND old IS DISTINCT FROM w.known THEN 'BROKEN_CHAIN' END
         WHEN w.known IS NULL OR hash = w.known OR declared THEN NULL
         WHEN w.prev IS NOT NULL AND hash = w.prev THEN CASE WHEN lagging THEN NULL ELSE 'PHANTOM_CHANGE' END ELSE 'UNEXPLAINED_CHANGE' END,
    f.t, coalesce(f.new, f.hash)
  FROM w JOIN f ON f.artifact = w.artifact AND f.n = w.n + 1),
fin AS (SELECT artifact, arg_max(known, n) AS final FROM w GROUP BY artifact)
SELECT finding AS kind, artifact, t, state FROM w WHERE finding IS NOT NULL
UNION ALL SELECT 'UNKNOWN_REVIEW', artifact, t, new FROM q3 WHERE lost
UNION ALL SELECT 'FAILED_REVIEW_STILL_LIVE', chg.artifact, review_t, new FROM chg JOIN fin ON fin.artifact = chg.artifact WHERE result = 'fail' AND final = new
UNION ALL SELECT 'UNREVIEWED_PAST_SLA', artifact, t, new FROM chg, (SELECT max(t) AS h FROM rec) WHERE coalesce(review_t, h) - t > 86400.0
"""
)


def reconcile(spark, sf_dir):
    return accounting.reconcile(views.updates(spark, sf_dir))


QUERIES["reconcile"] = reconcile
ORACLE_SQL["reconcile"] = _RECONCILE


def update_records(spark, sf_dir):
    return views.updates(spark, sf_dir).drop("ord")


QUERIES["update_records"] = update_records
ORACLE_SQL["update_records"] = f"WITH {RECORDS} SELECT type, t, artifact, old, new, hash, result, seq FROM rec"


def review_pairs(spark, sf_dir):
    changes, _ = accounting.reviewed(views.updates(spark, sf_dir))
    return changes.select("artifact", "new", "t", "review_t", "result")


QUERIES["review_pairs"] = review_pairs
ORACLE_SQL["review_pairs"] = f"WITH {REVIEWS} SELECT artifact, new, t, review_t, result FROM chg"


def pacing(spark, sf_dir):
    out = accounting.pacing(views.updates(spark, sf_dir))
    return behaviour._round(out, "span_days", "changes_per_day", "reviews_per_day", "growth_per_day", "lag_median_h", "lag_p95_h", "within_sla")


QUERIES["pacing"] = pacing
ORACLE_SQL["pacing"] = f"""WITH {REVIEWS},
g AS (SELECT count(*) AS c, count(review_t) AS r, min(t) AS t0, max(t) AS t1, (SELECT max(t) FROM rec) AS h, quantile_cont(review_t - t, 0.5) AS p50, quantile_cont(review_t - t, 0.95) AS p95,
  avg(CASE WHEN review_t IS NOT NULL THEN CAST(review_t - t <= 86400.0 AS INT) END) AS within FROM chg),
d AS (SELECT *, greatest((h - t0) / 86400, 1e-9) AS days, CAST(greatest(20, least(200, floor(greatest((h - t0) / 86400, 1e-9) * 2))) AS INT) AS n, greatest(h, t1) - t0 AS len FROM g),
grid AS (SELECT unnest(range(0, n)) AS i, n, t0, len FROM d),
b AS (SELECT i, len / (n - 1) / 86400 AS step, (SELECT count(*) FROM chg WHERE ceil((t - t0) * (n - 1) / len) <= i) - (SELECT count(*) FROM chg WHERE review_t IS NOT NULL AND ceil((review_t - t0) * (n - 1) / len) <= i) AS b FROM grid)
SELECT c AS changes, r AS reviewed, c - r AS unreviewed_now, round(days, 6) AS span_days, round(c / days, 6) AS changes_per_day, round(r / days, 6) AS reviews_per_day, (SELECT max(b) FROM b) AS peak_backlog,
  round((SELECT regr_slope(b, i) / first(step) FROM b), 6) AS growth_per_day, round(p50 / 3600, 6) AS lag_median_h, round(p95 / 3600, 6) AS lag_p95_h, round(within, 6) AS within_sla FROM d"""


def _sealed(spark, sf_dir):
    r = views.updates(spark, sf_dir).where("type = 'change'").select("t", "seq", F.concat_ws("|", "artifact", F.coalesce("old", F.lit("-")), "new").alias("text"))
    return accounting.chained(r, ["t", "seq"], "text")


def sealed_ledger(spark, sf_dir):
    """The hash chain over all declared changes."""
    return _sealed(spark, sf_dir).select("n", "text", "hash")


QUERIES["sealed_ledger"] = sealed_ledger
_LEDGER = "c AS (SELECT row_number() OVER (ORDER BY t, seq) - 1 AS n, concat_ws('|', artifact, coalesce(old, '-'), new) AS text FROM rec WHERE type = 'change')"
ORACLE_SQL["sealed_ledger"] = f"""WITH RECURSIVE {RECORDS}, {_LEDGER},
l AS (SELECT CAST(-1 AS BIGINT) AS n, repeat('0', 64) AS hash UNION ALL SELECT c.n, sha256(l.hash || c.text) FROM l JOIN c ON c.n = l.n + 1)
SELECT c.n, c.text, l.hash FROM c JOIN l USING (n)"""


def ledger_check(spark, sf_dir):
    """Broken links of the chain after one record was edited."""
    edited = _sealed(spark, sf_dir).withColumn("text", F.when(F.col("n") == 7, "edited").otherwise(F.col("text")))
    return accounting.broken_links(edited, "text").select("n")


QUERIES["ledger_check"] = ledger_check
ORACLE_SQL["ledger_check"] = "SELECT CAST(7 AS BIGINT) AS n"


def merkle(spark, sf_dir):
    r = views.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").alias("text"))
    return spark.createDataFrame([(accounting.merkle_root(r, ["o_orderkey"], "text"),)], "root string")


QUERIES["merkle_root"] = merkle
_LEVELS = 24
ORACLE_SQL["merkle_root"] = """WITH RECURSIVE m AS (
  SELECT 0 AS lv, list(sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus) ORDER BY o_orderkey) AS h FROM orders
  UNION ALL SELECT lv + 1, list_transform(range(0, CAST(ceil(len(h) / 2.0) AS BIGINT)), lambda i: sha256(h[2 * i + 1] || h[least(2 * i + 2, len(h))])) FROM m WHERE len(h) > 1)
SELECT h[1] AS root FROM m WHERE len(h) = 1"""


def state_hashes(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return accounting.state_hash(p, ["p_brand"], "p_name", "p_size")


QUERIES["state_hashes"] = state_hashes
ORACLE_SQL["state_hashes"] = "SELECT p_brand, substr(sha256(string_agg(p_name || ':' || CAST(p_size AS VARCHAR), ';' ORDER BY p_name, p_size)), 1, 16) AS state FROM part GROUP BY p_brand"

# ------------------------------------------------------------------------ sketches


def control_sketch(spark, sf_dir):
    rows, key = commons.control_writes(views.chunks(spark, sf_dir), 3600.0)
    return commons.sketch(rows, key, width=512, depth=4)


QUERIES["control_sketch"] = control_sketch
_AB = ", ".join(f"({r}, {a}::HUGEINT, {b}::HUGEINT)" for r, (a, b) in enumerate(commons.coefficients(4)))
ORACLE_SQL["control_sketch"] = f"""WITH {behaviour.CHUNKS}
SELECT h.row, CAST((h.a * (CAST(target AS HUGEINT) * 10000000 + CAST(floor(t / 3600.0) AS HUGEINT)) + h.b) % {commons.P61}::HUGEINT % 512 AS INT) AS col, CAST(count(*) AS DOUBLE) AS v
FROM r, (VALUES {_AB}) h(row, a, b) WHERE kind = 1 AND target < 7 GROUP BY 1, 2"""


def merged_sketch_spikes(spark, sf_dir):
    """Spikes that the sum of the agents' own sketches shows."""
    rows, key = commons.control_writes(views.chunks(spark, sf_dir), 3600.0)
    parts = [commons.sketch(rows.where(F.col("agent") == a), key) for a in range(4)]
    return commons.spikes(commons.merged(*parts), 0.0, 43_199.0, 3600.0, z=2.0)


QUERIES["merged_sketch_spikes"] = merged_sketch_spikes
_AB5 = ", ".join(f"({r}, {a}::HUGEINT, {b}::HUGEINT)" for r, (a, b) in enumerate(commons.coefficients(5)))
ORACLE_SQL["merged_sketch_spikes"] = f"""WITH {behaviour.CHUNKS}, hh AS (SELECT * FROM (VALUES {_AB5}) h(row, a, b)),
sk AS (SELECT hh.row, (hh.a * (CAST(target AS HUGEINT) * 10000000 + CAST(floor(t / 3600.0) AS HUGEINT)) + hh.b) % {commons.P61}::HUGEINT % 2048 AS col, count(*) AS v FROM r, hh WHERE kind = 1 AND target < 7 GROUP BY 1, 2),
g AS (SELECT c.c, b.b, CAST(c.c AS HUGEINT) * 10000000 + b.b AS key FROM range(7) c(c), range(12) b(b)),
e AS (SELECT g.c, g.b, CAST(min(coalesce(v, 0)) AS DOUBLE) AS est FROM g CROSS JOIN hh LEFT JOIN sk ON sk.row = hh.row AND sk.col = (hh.a * g.key + hh.b) % {commons.P61}::HUGEINT % 2048 GROUP BY 1, 2),
m AS (SELECT quantile_cont(est, 0.5) AS med FROM e), d AS (SELECT quantile_cont(abs(est - med), 0.5) AS mad FROM e, m)
SELECT CAST(c AS INT) AS class, CAST(b * 3600.0 AS DOUBLE) AS bin_start, est AS estimate FROM e, m, d WHERE est - med > 2.0 * greatest(1.4826 * mad, 1.0)"""

_BITS = [1, 0, 1, 1, 0, 0, 1, 0, 1, 1, 1, 0]
_MASK = sum(b << k for k, b in enumerate(_BITS))


def hadamard_code(spark, sf_dir):
    return commons.corrupted(commons.codeword(spark, _BITS), 0.1, 3)


QUERIES["hadamard_code"] = hadamard_code
_CODE = f"""(SELECT i, CASE WHEN ('0x' || substr(md5(CAST(i AS VARCHAR) || ':3'), 1, 8))::UBIGINT / 4294967296.0 < 0.1 THEN 1 - bit_count(i & {_MASK}) % 2 ELSE bit_count(i & {_MASK}) % 2 END AS bit FROM range({1 << 12}) t(i))"""
ORACLE_SQL["hadamard_code"] = f"SELECT i, CAST(bit AS INT) AS bit FROM {_CODE}"


def hadamard_decode(spark, sf_dir):
    return commons.decoded_bits(hadamard_code(spark, sf_dir), 12, 31, 5)


QUERIES["hadamard_decode"] = hadamard_decode
ORACLE_SQL["hadamard_decode"] = f"""WITH code AS {_CODE}, v AS (SELECT CAST(floor(id / 31) AS INT) AS k, CAST(floor(('0x' || substr(md5(CAST(id AS VARCHAR) || ':5:r'), 1, 8))::UBIGINT / 4294967296.0 * 4096) AS BIGINT) AS r FROM range({12 * 31}) t(id))
SELECT k, CAST(avg(xor(a.bit, b.bit)) > 0.5 AS INT) AS decoded FROM v JOIN code a ON a.i = r JOIN code b ON b.i = xor(r, CAST(1 AS BIGINT) << k) GROUP BY k"""


def linearity_test(spark, sf_dir):
    return behaviour._round(commons.linearity_rejections(hadamard_code(spark, sf_dir), 12, 2000, 5), "rejected")


QUERIES["linearity_test"] = linearity_test
_U = "CAST(floor(('0x' || substr(md5(CAST(id AS VARCHAR) || ':5:{0}'), 1, 8))::UBIGINT / 4294967296.0 * 4096) AS BIGINT)"
ORACLE_SQL["linearity_test"] = f"""WITH code AS {_CODE}, v AS (SELECT {_U.format("x")} AS x, {_U.format("y")} AS y FROM range(2000) t(id))
SELECT round(avg(CAST(xor(a.bit, b.bit) <> c.bit AS INT)), 6) AS rejected FROM v JOIN code a ON a.i = x JOIN code b ON b.i = y JOIN code c ON c.i = xor(x, y)"""
