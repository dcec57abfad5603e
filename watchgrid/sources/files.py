"""Readers of the logs that the engine judges. All tolerate bad lines and missing fields."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.functions import scalars
from watchgrid.sources.incidents import INCIDENTS

#: Loaders that plug-ins add: name -> function of (spark, path) that gives trace events.
LOADERS: dict = {}


def _lines(spark: SparkSession, path: str, pattern: str = "*.jsonl*") -> DataFrame:
    """Lines of a file, of all files below a folder that match, or of the files that a path with wildcards names; gzip is read as it is."""
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.text(path).where(F.trim("value") != "") if not _is_folder(spark, path) else reader.option("pathGlobFilter", pattern).text(path).where(F.trim("value") != "")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if any(c in path for c in "*?[{"):
        return False
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).getFileStatus(p).isDirectory()


def _field(line: Column, *names: str) -> Column:
    """The first of several top-level fields that is there, as text."""
    return F.coalesce(*[F.get_json_object(line, f"$.{n}") for n in names])


def _as_trace(df: DataFrame, trace_id: int = 0) -> DataFrame:
    """Adds trace_id and seq (the rank by time; rows of one time keep an arbitrary but fixed order)."""
    df = df.withColumn("trace_id", F.lit(trace_id).cast("long")).withColumn("seq", F.monotonically_increasing_id())
    return df.select("trace_id", "seq", "t", "agent", "kind", "target", "size", "value", "chan")


def read_events(spark: SparkSession, path: str, chan: int = 0) -> DataFrame:
    """Generic events, one JSON object a line: t and kind or tool; optional target, size, value, agent, chan."""
    x = F.col("value")
    df = _lines(spark, path).select(
        _field(x, "t").try_cast("double").alias("t"), _field(x, "kind").alias("kind_name"), _field(x, "tool").alias("tool"), F.coalesce(_field(x, "target"), F.lit("")).alias("path"),
        F.coalesce(_field(x, "size").try_cast("double"), F.lit(0.0)).alias("size"), _field(x, "value").try_cast("double").alias("value"),
        F.coalesce(_field(x, "agent").try_cast("int"), F.lit(0)).alias("agent"), F.coalesce(_field(x, "chan").try_cast("int"), F.lit(chan)).alias("chan"),
    )
    df = df.where(F.col("t").isNotNull() & (F.col("kind_name").isNotNull() | F.col("tool").isNotNull()))
    names = F.create_map(*[F.lit(v) for i, k in enumerate(model.KINDS) for v in (k, i)])
    df = df.withColumn("kind", F.when(F.col("kind_name").isNotNull(), F.coalesce(F.try_element_at(names, F.col("kind_name")), F.lit(model.BASH))).otherwise(scalars.tool_kind(F.col("tool"))))
    named = F.element_at(F.array(*[F.lit(k) for k in model.KINDS]), F.col("kind") + 1)
    return _as_trace(df.withColumn("target", _target(F.col("path"), F.col("kind"), F.when(F.col("path") == "", named).otherwise(F.col("path")))))


def _target(path: Column, kind: Column, key: Column) -> Column:
    """Control class of a write to a control file, else the bucket of the key."""
    c = scalars.control_class(path)
    return F.when((kind == model.WRITE) & (path != "") & (c >= 0), c).otherwise(scalars.file_bucket(key))


_ASSISTANT = "type string, timestamp string, isSidechain boolean, message struct<content: array<struct<type: string, name: string, input: map<string,string>>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Assistant transcripts: one event for each tool_use block of the assistant's messages. size is the length of the input as compact JSON."""
    row = F.from_json("value", _ASSISTANT)
    df = _lines(spark, path).select(row.alias("r")).where("r.type = 'assistant' AND r.timestamp IS NOT NULL").select("r.timestamp", "r.isSidechain", F.explode("r.message.content").alias("b"))
    df = df.where("b.type = 'tool_use'").select(scalars.parse_time(F.col("timestamp")).alias("t"), F.when(F.col("isSidechain"), 1).otherwise(0).alias("agent"), F.coalesce("b.name", F.lit("")).alias("name"), F.col("b.input").alias("input"))
    got = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("input", F.lit(n)), F.lit("")) for n in names], F.lit(""))
    df = df.withColumns({"path": got("file_path", "path", "notebook_path"), "command": got("command"), "url": got("url"), "kind": scalars.tool_kind(F.col("name"))})
    tests = F.lit(False)
    for w in model.TEST_COMMANDS:
        tests = tests | F.col("command").contains(w)
    df = df.withColumn("kind", F.when((F.col("kind") == model.BASH) & tests, model.TEST).otherwise(F.col("kind")))
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("path", "command", "url")], F.col("name"))
    df = df.withColumns({"target": _target(F.col("path"), F.col("kind"), key), "size": F.coalesce(F.length(F.to_json("input")), F.lit(2)).cast("double"), "value": F.lit(None).cast("double"), "chan": F.lit(0)})
    return _as_trace(df.where("t IS NOT NULL"))


def read_sessions(spark: SparkSession, path: str, group_by: str = "model", gap: float = 3600.0) -> DataFrame:
    """Session logs with arrays of tool calls: trace events with a `label` per group. The sessions of a group are laid end to end, `gap` seconds apart."""
    schema = f"{group_by} string, session_id string, tools array<struct<tool_name: string, emitted_at: string, input_chars: long, is_error: boolean>>"
    df = _lines(spark, path).select(F.from_json("value", schema).alias("r")).select(F.coalesce(f"r.{group_by}", F.lit("unknown")).alias("label"), F.coalesce("r.session_id", F.lit("s")).alias("session"), F.explode("r.tools").alias("x"))
    df = df.select("label", "session", scalars.parse_time(F.col("x.emitted_at")).alias("t"), F.coalesce("x.tool_name", F.lit("")).alias("tool"), F.coalesce("x.input_chars", F.lit(0)).cast("double").alias("size")).where("t IS NOT NULL")
    spans = df.groupBy("label", "session").agg(F.min("t").alias("first"), (F.max("t") - F.min("t") + gap).alias("span"))
    before = Window.partitionBy("label").orderBy("first", "session").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("offset", F.coalesce(F.sum("span").over(before), F.lit(0.0)))
    df = df.join(spans, ["label", "session"]).withColumn("t", F.col("t") - F.col("first") + F.col("offset"))
    df = df.withColumns({"kind": scalars.kind_by_rule(F.col("tool")), "target": scalars.file_bucket(F.col("tool")), "agent": F.lit(0), "value": F.lit(None).cast("double"), "chan": F.lit(0)})
    return df.withColumn("trace_id", F.xxhash64("label")).withColumn("seq", F.monotonically_increasing_id()).select("label", "trace_id", "seq", "t", "agent", "kind", "target", "size", "value", "chan")


def read_csv_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as CSV with a header: time, tool, size."""
    df = spark.read.csv(path, header=True, schema="time double, tool string, size double").where("time IS NOT NULL")
    df = df.select(F.col("time").alias("t"), F.lit(0).alias("agent"), scalars.kind_by_rule(F.col("tool")).alias("kind"), scalars.file_bucket(F.col("tool")).alias("target"), F.coalesce("size", F.lit(0.0)).alias("size"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("chan"))
    return _as_trace(df)


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Events of a path: by a plug-in's loader, else as transcripts, else as generic events."""
    if fmt:
        if fmt not in LOADERS:
            raise ValueError(f"unknown format {fmt}; plug-ins have added {', '.join(sorted(LOADERS)) or 'none'}")
        return LOADERS[fmt](spark, path)
    found = read_transcripts(spark, path)
    return found if not found.isEmpty() else read_events(spark, path)


_TIMES = ("t", "time", "timestamp", "ts")


def flat_text(x: Column) -> Column:
    """Text of a JSON value: strings as they are, blocks with a text field joined by spaces, all else as its JSON."""
    blocks = F.from_json(x, "array<struct<text: string>>")
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), " ")
    return F.when(x.startswith("["), F.coalesce(F.nullif(joined, F.lit("")), x)).otherwise(x)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages, one JSON object a line, under any of several field names; rows without time or text are left out."""
    x = F.col("value")
    df = _lines(spark, path).select(
        F.monotonically_increasing_id().alias("msg_id"), scalars.parse_time(_field(x, *_TIMES)).alias("t"), F.coalesce(_field(x, "from", "sender", "agent"), F.lit("?")).alias("sender"),
        _field(x, "to", "receiver", "recipient").alias("receiver"), flat_text(_field(x, "text", "content", "message", "body")).alias("text"),
    )
    return df.where("t IS NOT NULL AND text IS NOT NULL")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Actions (t, agent, label), under any of several field names."""
    x = F.col("value")
    df = _lines(spark, path).select(scalars.parse_time(_field(x, *_TIMES)).alias("t"), F.coalesce(_field(x, "agent", "agent_id", "actor", "from"), F.lit("0")).alias("agent"), _field(x, "tool", "tool_name", "name", "kind", "action").alias("label"))
    return df.where("t IS NOT NULL AND label IS NOT NULL")


def actions_of(trace: DataFrame) -> DataFrame:
    """Actions of trace events: what the agents did, by kind."""
    return trace.where("chan = 0").select("t", F.col("agent").cast("string").alias("agent"), F.element_at(F.array(*[F.lit(k) for k in model.KINDS]), F.col("kind") + 1).alias("label"))


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Change, snapshot and review records; others, and those without time or artifact, are left out."""
    x = F.col("value")
    df = _lines(spark, path).select(*[_field(x, n).alias(n) for n in ("type", "artifact", "old", "new", "hash", "actor", "kind", "by", "result")], scalars.parse_time(_field(x, "t")).alias("t"))
    df = df.where(F.col("type").isin("change", "snapshot", "review") & F.col("t").isNotNull() & F.col("artifact").isNotNull())
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled transcripts (id, text, label): text or turns under any of several names; a missing label is 0."""
    x = F.col("value")
    turns = F.from_json(_field(x, "text", "transcript", "messages", "turns"), "array<struct<role: string, text: string, content: string>>")
    rendered = F.array_join(F.transform(turns, lambda m: F.concat_ws(": ", m["role"], F.coalesce(m["text"], m["content"]))), "\n")
    text = _field(x, "text", "transcript", "messages", "turns")
    label = _field(x, "label", "flag", "y")
    df = _lines(spark, path).select(F.coalesce(_field(x, "id"), F.monotonically_increasing_id().cast("string")).alias("id"), F.when(text.startswith("["), F.coalesce(rendered, text)).otherwise(text).alias("text"), F.when(F.lower(label) == "true", 1).otherwise(F.coalesce(label.try_cast("int"), F.lit(0))).alias("label"))
    return df.where("text IS NOT NULL")


INCIDENT_SCHEMA = "name string, note string, source string, duration_s double, phases array<struct<name: string, start: double, `end`: double, actions: int, kinds: array<string>, mix: map<string,double>, net_bytes_each: double, write_bytes_each: double>>, net_bytes_range array<double>"


def read_incident(spark: SparkSession, path: str) -> DataFrame:
    """One row per phase of a recorded incident."""
    df = spark.read.schema(INCIDENT_SCHEMA).json(path, multiLine=True)
    return df.select("name", "duration_s", "net_bytes_range", F.posexplode("phases").alias("phase_no", "p")).select(F.col("name").alias("incident"), "duration_s", "net_bytes_range", "phase_no", "p.*")


def snapshot(spark: SparkSession, paths: list[str], t: float) -> DataFrame:
    """Snapshot records of files (their hash) and folders (the hash of their sorted relative paths and file hashes)."""
    out = None
    for path in paths:
        if _is_folder(spark, path):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").contains("/.git/"))
            plain = F.regexp_replace("path", r"^file:/*", "/")
            own = files.select(F.substring(plain, len(path.rstrip("/")) + 2, 1 << 20).alias("rel"), F.sha2("content", 256).alias("h"))
            own = own.groupBy().agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", "h"))), lambda f: F.concat(f["rel"], f["h"])), ""), 256).alias("hash"))
        else:
            own = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("hash"))
        own = own.select(F.lit("snapshot").alias("type"), F.lit(float(t)).alias("t"), F.lit(path).alias("artifact"), F.substring("hash", 1, 16).alias("hash"))
        out = own if out is None else out.unionByName(own)
    return out


def exported(trace: DataFrame, independent: bool = False) -> DataFrame:
    """Trace events under names, as a monitor from outside gets them: t, agent, kind, target, size, value; the independent record only if asked for."""
    kinds, controls = (F.array(*[F.lit(x) for x in names]) for names in (model.KINDS, model.CONTROL_FILES))
    number = F.col("target").cast("string")
    other = F.when(F.col("kind") == model.NET, F.concat(F.lit("host-"), number, F.lit(".example"))).when(F.col("kind").isin(model.BASH, model.TEST), F.concat(F.lit("cmd-"), number)).otherwise(F.concat(F.lit("src/file_"), number, F.lit(".py")))
    rows = trace if independent else trace.where("chan = 0")
    name = F.when(F.col("target") < model.N_CONTROL, F.element_at(controls, F.least(F.col("target"), F.lit(model.N_CONTROL - 1)) + 1)).otherwise(other)
    return rows.select("trace_id", F.bround("t", 3).alias("t"), "agent", F.element_at(kinds, F.col("kind") + 1).alias("kind"), name.alias("target"), F.bround("size", 1).alias("size"), "value", "chan")


def list_incidents() -> list[str]:
    return sorted(INCIDENTS)


def incident_phases(spark: SparkSession, name: str) -> DataFrame:
    """Phases of an incident that comes with the library, as read_incident gives them."""
    row = json.dumps({"name": name, **INCIDENTS[name]})
    found = spark.createDataFrame([(row,)], "value string").select(F.from_json("value", INCIDENT_SCHEMA).alias("r"))
    return found.select("r.*").select("name", "duration_s", "net_bytes_range", F.posexplode("phases").alias("phase_no", "p")).select(F.col("name").alias("incident"), "duration_s", "net_bytes_range", "phase_no", "p.*")
