"""Queries on readers: rows of the driver's tables are written as logs of each format, with broken lines between them, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.plans import accounts, behaviour
from watchgrid.plans.behaviour import _round
from watchgrid.sources import files, tables, views

QUERIES, ORACLE_SQL = {}, {}

_BUCKET = "CAST(('0x' || md5({0}))::UHUGEINT % 300 + 7 AS INT)"
_EV = """
ev AS (SELECT event_id, epoch(ts) AS t, CAST(user_id % 4 AS INT) AS agent, user_id, event_type AS e, value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("timestamp").cast("double").alias("t"), (F.col("user_id") % 4).cast("int").alias("agent"), "user_id", F.col("event_type").alias("e"), F.col("value").alias("v"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))


def _logged(lines: DataFrame, broken: bool = True) -> str:
    """Writes a column of JSON lines, and after every 50th a broken and an empty line; returns their path."""
    spark = lines.sparkSession
    path = tables.shared_dir(spark)
    if broken:
        lines = lines.withColumn("value", F.explode(F.when(F.abs(F.xxhash64("value")) % 50 == 0, F.array("value", F.lit('{"tool": "Read", "t": '), F.lit("  "))).otherwise(F.array("value"))))
    lines.select("value").write.text(path)
    tables.deleted_on_exit(spark, path)
    return f"{path}/part-*"


_TOOL = "CASE e WHEN 'view' THEN 'Read' WHEN 'signup' THEN 'Edit' WHEN 'click' THEN 'Grep' WHEN 'purchase' THEN 'WebFetch' ELSE CASE WHEN event_id % 2 = 0 THEN 'Bash' ELSE 'custom_7' END END"
_PATH = "CASE WHEN e = 'signup' AND k < 10 THEN CASE WHEN k % 2 = 0 THEN 'x/.claude/settings.json' ELSE 'docs/AGENTS.md' END WHEN e = 'purchase' THEN concat('host', k, '.example') ELSE concat('src/f', k, '.py') END"
_KIND = "CASE e WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE 2 END"


def generic_log(spark, sf_dir):
    """Events as generic JSON lines, some by tool and some by kind."""
    e = _events(spark, sf_dir).withColumns({"path": F.expr(_PATH), "tool": F.expr(_TOOL)})
    fields = [F.col("t"), F.col("path").alias("target"), F.col("agent"), F.col("v").alias("size"), F.when(F.col("e") == "error", F.col("v")).alias("value")]
    line = F.when(F.col("e") == "click", F.to_json(F.struct(*fields, F.lit("search").alias("kind")))).otherwise(F.to_json(F.struct(*fields, F.col("tool"))))
    return _round(files.load(spark, _logged(e.select(line.alias("value")))).drop("trace_id", "seq"), "t", "size", "value")


QUERIES["generic_log"] = generic_log
ORACLE_SQL["generic_log"] = f"""WITH {_EV}, p AS (SELECT *, {_PATH} AS path FROM ev)
SELECT round(t, 6) AS t, agent, {_KIND} AS kind, CASE WHEN path = 'docs/AGENTS.md' THEN 0 WHEN path = 'x/.claude/settings.json' THEN 2 ELSE {_BUCKET.format("path")} END AS target, round(v, 6) AS size,
  CASE WHEN e = 'error' THEN round(v, 6) END AS value, 0 AS chan FROM p"""

_INPUT = "CASE e WHEN 'error' THEN map('command', CASE WHEN k % 3 = 0 THEN concat('pytest -q t', k) ELSE concat('ls d', k) END) WHEN 'purchase' THEN map('url', concat('https://h', k, '.example')) ELSE map('file_path', {0}) END"


def assistant_log(spark, sf_dir):
    """Events as an assistant's transcript: tool_use blocks among text blocks, times in ISO form."""
    e = _events(spark, sf_dir).withColumn("path", F.expr(_PATH)).withColumn("name", F.expr(_TOOL)).withColumn("input", F.expr(_INPUT.format("path")))
    none = F.lit(None)
    block = F.struct(F.lit("tool_use").alias("type"), F.col("name"), F.col("input"))
    text = F.struct(F.lit("text").alias("type"), none.cast("string").alias("name"), none.cast("map<string,string>").alias("input"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), (F.col("agent") > 1).alias("isSidechain"), F.struct(F.array(text, block).alias("content")).alias("message")))
    return _round(files.load(spark, _logged(e.select(line.alias("value")))).drop("trace_id", "seq", "value"), "t", "size")


QUERIES["assistant_log"] = assistant_log
ORACLE_SQL["assistant_log"] = f"""WITH {_EV}, p AS (SELECT *, {_PATH} AS path FROM ev),
i AS (SELECT *, CASE e WHEN 'error' THEN 'command' WHEN 'purchase' THEN 'url' ELSE 'file_path' END AS f, CASE e WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN concat('pytest -q t', k) ELSE concat('ls d', k) END WHEN 'purchase' THEN concat('https://h', k, '.example') ELSE path END AS x FROM p)
SELECT round(t, 6) AS t, CAST(agent > 1 AS INT) AS agent, CASE WHEN e = 'error' AND k % 3 = 0 THEN 4 ELSE {_KIND} END AS kind,
  CASE WHEN e = 'signup' AND x = 'docs/AGENTS.md' THEN 0 WHEN e = 'signup' AND x = 'x/.claude/settings.json' THEN 2 ELSE {_BUCKET.format("x")} END AS target, CAST(length(f) + length(x) + 7 AS DOUBLE) AS size, 0 AS chan FROM i"""


def session_log(spark, sf_dir):
    """Events as session logs with arrays of calls, three models with their users' sessions laid end to end."""
    e = _events(spark, sf_dir).withColumn("tool", F.expr(_TOOL)).where("user_id % 7 < 3")
    call = F.struct(F.col("tool").alias("tool_name"), F.col("t").cast("string").alias("emitted_at"), F.col("k").cast("long").alias("input_chars"), F.lit(False).alias("is_error"))
    s = e.groupBy(F.concat(F.lit("m"), F.col("user_id") % 7).alias("model"), F.concat(F.lit("s"), F.lpad(F.col("user_id") % 20, 2, "0")).alias("session_id")).agg(F.collect_list(call).alias("tools"))
    got = files.read_sessions(spark, _logged(s.select(F.to_json(F.struct("model", "session_id", "tools")).alias("value"))))
    return _round(got.select("label", "t", "kind", "target", "size"), "t", "size", places=3)


QUERIES["session_log"] = session_log
ORACLE_SQL["session_log"] = f"""WITH {_EV}, x AS (SELECT concat('m', user_id % 7) AS label, concat('s', lpad(CAST(user_id % 20 AS VARCHAR), 2, '0')) AS s, t, {_TOOL} AS tool, k, {_KIND} AS kind FROM ev WHERE user_id % 7 < 3),
g AS (SELECT label, s, min(t) AS first, max(t) - min(t) + 3600.0 AS span FROM x GROUP BY label, s),
o AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY label ORDER BY first, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS o FROM g)
SELECT x.label, round(t - first + o, 3) AS t, kind, {_BUCKET.format("tool")} AS target, CAST(k AS DOUBLE) AS size FROM x JOIN o ON o.label = x.label AND o.s = x.s"""


def csv_log(spark, sf_dir):
    """Events as CSV."""
    e, path = _events(spark, sf_dir).withColumn("tool", F.expr(_TOOL)), tables.shared_dir(spark)
    e.select(F.col("t").alias("time"), "tool", F.when(F.col("k") % 5 > 0, F.col("v")).alias("size")).write.csv(path, header=True)
    tables.deleted_on_exit(spark, path)
    return _round(files.read_csv_events(spark, path).select("t", "kind", "target", "size"), "t", "size")


QUERIES["csv_log"] = csv_log
ORACLE_SQL["csv_log"] = f"WITH {_EV}, x AS (SELECT *, {_TOOL} AS tool FROM ev) SELECT round(t, 6) AS t, {_KIND} AS kind, {_BUCKET.format('tool')} AS target, CASE WHEN k % 5 > 0 THEN round(v, 6) ELSE 0.0 END AS size FROM x"


def message_log(spark, sf_dir):
    """Turns as messages under three sets of field names, times in milliseconds, seconds and ISO form."""
    m = views.messages(spark, sf_dir).withColumn("way", F.col("msg_id") % 3)
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    iso = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    one = F.to_json(F.struct((F.col("t") * 1000).alias("t"), F.col("sender").alias("from"), F.col("receiver").alias("to"), "text"))
    two = F.to_json(F.struct(iso.alias("timestamp"), "sender", F.col("receiver").alias("recipient"), block.alias("content")))
    line = F.when(F.col("way") == 0, one).when(F.col("way") == 1, two).otherwise(F.to_json(F.struct(F.col("t").alias("ts"), F.col("text").alias("message"))))
    return _round(files.read_messages(spark, _logged(m.select(line.alias("value")))).drop("msg_id"), "t", places=3)


QUERIES["message_log"] = message_log
ORACLE_SQL["message_log"] = """WITH s0 AS (SELECT min(epoch(ts)) AS t0 FROM events),
m AS (SELECT (conv_id * 1000 + turn) % 3 AS way, t0 + conv_id * 600 + turn * 30 AS t, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS receiver, text FROM conversations, s0)
SELECT round(t, 3) AS t, CASE WHEN way < 2 THEN role ELSE '?' END AS sender, CASE WHEN way < 2 THEN receiver END AS receiver, text FROM m"""


def action_log(spark, sf_dir):
    """Events as actions under two sets of field names."""
    e = _events(spark, sf_dir)
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("t").alias("time"), F.col("agent").alias("agent_id"), F.col("e").alias("tool_name")))).otherwise(F.to_json(F.struct(F.col("t").alias("ts"), F.col("e").alias("action"))))
    return _round(files.read_actions(spark, _logged(e.select(line.alias("value")))), "t")


QUERIES["action_log"] = action_log
ORACLE_SQL["action_log"] = f"WITH {_EV} SELECT round(t, 6) AS t, CASE WHEN event_id % 2 = 0 THEN CAST(agent AS VARCHAR) ELSE '0' END AS agent, e AS label FROM ev"


def update_log(spark, sf_dir):
    """Change, snapshot and review records, with records of other types between them."""
    r = views.updates(spark, sf_dir)
    line = F.to_json(F.struct("type", "t", "artifact", "old", "new", "hash", "result"))
    other = r.where("seq % 40 = 0").select(F.to_json(F.struct(F.lit("note").alias("type"), "t", "artifact")).alias("value"))
    return files.read_updates(spark, _logged(r.select(line.alias("value")).unionByName(other))).select("type", "t", "artifact", "old", "new", "hash", "result")


QUERIES["update_log"] = update_log
ORACLE_SQL["update_log"] = f"WITH {accounts.RECORDS} SELECT type, t, artifact, old, new, hash, result FROM rec"


def labelled_log(spark, sf_dir):
    """Labelled documents as texts, and as turns with a flag."""
    d = views.transcripts(spark, sf_dir)
    one = F.to_json(F.struct("id", "text", "label"))
    two = F.to_json(F.struct("id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("tool").alias("role"), F.lit("done").alias("content"))).alias("messages"), (F.col("label") == 1).alias("flag")))
    line = F.when(F.col("id").cast("long") % 2 == 0, one).otherwise(two)
    return files.read_labelled(spark, _logged(d.select(line.alias("value")), broken=False))


QUERIES["labelled_log"] = labelled_log
ORACLE_SQL["labelled_log"] = """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'user: ' || text || chr(10) || 'tool: done' END AS text, CAST(toxic AS INT) AS label
FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL"""


def trace_actions(spark, sf_dir):
    """What the agents did, by kind."""
    return _round(files.actions_of(views.chunks(spark, sf_dir)), "t")


QUERIES["trace_actions"] = trace_actions
ORACLE_SQL["trace_actions"] = f"WITH {behaviour.CHUNKS} SELECT round(t, 6) AS t, CAST(agent AS VARCHAR) AS agent, (['read', 'write', 'bash', 'search', 'test', 'net'])[kind + 1] AS label FROM r"
