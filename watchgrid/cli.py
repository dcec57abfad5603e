"""Command line: python -m watchgrid.cli SUBCOMMAND. Results go to a folder as JSON and Markdown."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid import plugins, reports
from watchgrid.operators import accounting, attacks, channel, commons, detection, drift, external, gate, lenses, profile, stack, texts, weights
from watchgrid.sources import files, tables
from watchgrid.sources.git import read_git

#: Detectors without Python in them, for --quick.
FAST = tuple(n for n in lenses.DEFAULT if n not in ("clock", "digits"))


def _names(a) -> tuple[str, ...]:
    return FAST if getattr(a, "quick", False) else tuple(lenses.DEFAULT)


def session() -> SparkSession:
    return SparkSession.builder.appName("watchgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def report(out: str, name: str, text: str | None = None, **parts) -> None:
    """Small results as JSON, and as Markdown: the given text, or else tables."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(parts, indent=1, default=str))
    if text is None:
        text = reports.document(name, *[reports.section(title, reports.table(x if isinstance(x, list) else [x]) if x and isinstance(x, list | dict) and isinstance(x[0] if isinstance(x, list) else x, dict) else reports.cell(x)) for title, x in parts.items()])
    (folder / f"{name}.md").write_text(text)


def rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    return [r.asDict() for r in df.limit(most).collect()]


def _chunks(spark: SparkSession, a) -> DataFrame:
    trace = files.load(spark, a.path, getattr(a, "format", None))
    if getattr(a, "observed", None):
        trace = trace.unionByName(files.read_events(spark, a.observed, chan=1).withColumn("chan", F.lit(1)))
    return tables.written(profile.chunked(profile.compressed(trace), a.chunk))


def _profile(a, chunks: DataFrame):
    return profile.fit(chunks.withColumn("trace_id", F.lit(0).cast("long"))) if getattr(a, "path", None) else lenses.Profile()


def audit(spark, a) -> int:
    chunks = _chunks(spark, a) if a.path else tables.written(attacks.synthetic(spark, 60))
    prof, names = _profile(a, chunks), _names(a)
    found, _, told = external.of_lenses(chunks, prof, names, a.far, a.bases)
    quiet = tables.written(chunks.join(told.where("NOT detected").select("trace_id"), "trace_id", "left_semi"))
    library = [attacks.Spec(n, p, t0=0.15 * a.chunk) for n, p in attacks.LIBRARY.items()]
    th = tables.written(found.thresholds)
    curves = rows(attacks.curves(found.detections.groupBy("item").agg((F.max("detected") == 1).alias("detected")).join(found.items, "item")))
    parts = {
        "far": a.far, "profile": asdict(prof), "thresholds": rows(th), "false_alarms": rows(stack.false_alarm_rate(told)), "curves": curves,
        "library": rows(attacks.bench(library, quiet, prof, names, th)), "fuzz": rows(attacks.fuzz_coverage(attacks.fuzz(quiet, prof, names, th, a.fuzz))),
        "adaptive": attacks.disguised(quiet, prof, names, th, attacks.Spec("kill_chain", attacks.LIBRARY["kill_chain"], t0=0.15 * a.chunk), a.budget),
    }
    report(a.out, "audit", reports.audit(parts), **parts)
    return 0


def curves_command(spark, a) -> int:
    chunks = _chunks(spark, a)
    found, _, _ = external.of_lenses(chunks, _profile(a, chunks), _names(a), a.far, a.bases)
    curves = rows(attacks.curves(found.detections.groupBy("item").agg((F.max("detected") == 1).alias("detected")).join(found.items, "item")).orderBy("family", "k"))
    report(a.out, "curves", reports.curves(curves), curves=curves)
    return 0


def _monitors(a) -> dict:
    chosen = {s: plugins.monitor(s) for s in a.monitor or []} | dict(plugins.MONITORS)
    found = {n: lambda t, f=f: plugins.event_monitor(t, f) for n, f in chosen.items()}
    return found | {c: lambda t, c=c: plugins.command_event_monitor(t, c) for c in a.command or []}


def _audited(spark, a, chunks: DataFrame):
    """The audit of the monitors given, with the built-in detectors as one more, or that of the detectors alone; and a judge for adversaries in the latter case."""
    prof, names, monitors = _profile(a, chunks), _names(a), _monitors(a)
    if not monitors:
        found, judge, _ = external.of_lenses(chunks, prof, names, a.far, a.bases)
        return found, judge
    early = chunks.join(stack.split_chronological(chunks).where("part = 'cal'"), "trace_id", "left_semi")
    return external.audit(chunks, {**monitors, "built-in": external.lens_bundle(prof, names, early, a.far)}, prof, a.far, a.bases), None


def audit_monitor(spark, a) -> int:
    for p in a.plugin or []:
        plugins.load(p)
    found, _ = _audited(spark, a, _chunks(spark, a))
    parts = {"far": a.far, "false_alarms": rows(detection.rates(found.clean)), "thresholds": rows(found.thresholds), "sensitivity": rows(external.sensitivity(found)), "overlap": external.overlap(found)}
    report(a.out, "monitors", reports.monitors(parts), **parts)
    return 0


def gate_command(spark, a) -> int:
    for p in a.plugin or []:
        plugins.load(p)
    found, judge = _audited(spark, a, _chunks(spark, a))
    records = files.read_updates(spark, a.updates) if a.updates else None
    old = Path(a.ledger).read_text().splitlines() if a.ledger and Path(a.ledger).exists() else []
    adversary = attacks.hidden(judge, budget=a.budget) if judge and a.budget else None
    evidence = gate.Evidence(
        detections=found.detections, items=found.items, clean=found.clean, adversary=adversary, ledger=gate.ledger_state(old, a.witness),
        findings=accounting.reconcile(records) if records else None, pacing=accounting.assessed(records) if records else None,
    )
    policy = json.loads(Path(a.policy).read_text()) if a.policy else None
    judged = gate.criteria(evidence, policy)
    decision = gate.decide(judged)
    parts = {"step": a.step, "decision": decision, "criteria": [asdict(c) for c in judged], "adversary": adversary}
    report(a.out, "gate", reports.gate(parts), **parts)
    if a.save_policy:
        Path(a.save_policy).write_text(json.dumps(gate.baseline_policy(judged, policy), indent=1))
    if a.ledger:
        new = gate.ledger_append(old, {"step": a.step, "decision": decision, "criteria": {c.id: c.status for c in judged}})
        Path(a.ledger).write_text("\n".join(new) + "\n")
    return {"GO": 0, "NO-GO": 1}.get(decision, 3)


def updates(spark, a) -> int:
    records = read_git(spark, a.path, a.watch or ["."]) if a.git else files.read_updates(spark, a.path)
    found = accounting.reconcile(records, a.sla)
    n = found.where(F.col("kind").isin(*gate.ACCOUNTING)).count()
    parts = {"findings": rows(found.orderBy("t")), "pacing": accounting.assessed(records, a.sla)}
    report(a.out, "updates", reports.updates(parts), **parts)
    return int(bool(n and a.fail) or bool(a.fail_if_behind and parts["pacing"]["falling_behind"]))


def channel_command(spark, a) -> int:
    m = files.read_messages(spark, a.path)
    parts = {"profile": rows(channel.profile(m)), "hidden": rows(channel.hidden(m)), "decoded": rows(channel.decoded(m))}
    if a.actions:
        acts = files.read_actions(spark, a.actions)
        parts |= {"lexicon": rows(channel.ground(m, acts, rounds=a.rounds)), "informative": channel.informativeness(m, acts, rounds=a.rounds), "coordination": rows(channel.coordination(acts, rounds=a.rounds))}
    report(a.out, "channel", reports.channel(parts), **parts)
    return 0


def transcripts(spark, a) -> int:
    monitors = {s: texts.python_monitor(plugins.monitor(s)) for s in a.monitor or []} | {c: texts.command_monitor(c) for c in a.command or []}
    examples = files.read_labelled(spark, a.path)
    s = texts.scored(examples, monitors, texts.TRANSFORMS if a.kind == "transcript" else texts.REWRITES)
    s = tables.written(s)
    found = tables.written(texts.alarmed(s, texts.thresholds(s, a.far)))
    cover = rows(texts.coverage(found))
    parts = {"coverage": cover, "stability": rows(texts.stability(found)), "text_audit": rows(texts.text_audit(found)), "correlations": rows(detection.correlations(texts.detections(found)))}
    report(a.out, a.kind, reports.texts(a.kind, parts), **parts)
    low = min((r["rate"] for r in cover if r["label"] == 1), default=0.0)
    return 2 if a.least is not None and low < a.least else 0


def sessions_command(spark, a) -> int:
    trace = files.read_sessions(spark, a.path, a.group_by)
    chunks = tables.written(profile.chunked(profile.compressed(trace.drop("label")), a.chunk))
    labels = trace.groupBy("trace_id").agg(F.first("label").alias("label"))
    whole = profile.compressed(trace.drop("label"))
    start = whole.where("chan = 0").groupBy("trace_id").agg(F.min("t").alias("t0"))
    ids = whole.join(start, "trace_id").select("trace_id", F.floor((F.col("t") - F.col("t0")) / a.chunk).cast("long").alias("c")).distinct()
    groups = ids.join(labels, "trace_id").select(F.when(F.col("trace_id") == 0, F.col("c")).otherwise(F.xxhash64("trace_id", "c")).alias("trace_id"), F.col("label").alias("grp"))
    prof = replace(lenses.Profile(), win=a.chunk / 2)
    names = _names(a)
    s = tables.written(stack.scores(lenses.series(chunks, prof, names), chunks, names))
    parts = {"transfer": rows(drift.transfer(s, groups, len(names))), "time": rows(drift.time_drift(s, len(names)).orderBy("block")), "control": rows(drift.time_drift(s, len(names), shuffled=True).orderBy("block"))}
    parts["flagged"] = drift.drifted(parts["time"], parts["control"]) if {r["block"] for r in parts["time"]} <= {r["block"] for r in parts["control"]} else []
    report(a.out, "tracelab", reports.transfer(parts), **parts)
    return 0


def ablate(spark, a) -> int:
    """The stack with and without one detector: alarms, smallest strength caught, and the strongest attack that a search with --budget queries hides."""
    chunks = _chunks(spark, a)
    prof = replace(lenses.Profile(), win=a.chunk / 2)
    every = tuple(lenses.DEFAULT) if a.drop in ("clock", "digits") or not a.quick else FAST
    s = tables.written(stack.scores(lenses.series(chunks, prof, every), chunks, every))
    variants = rows(drift.ablation(s, every, a.drop).groupBy("variant").agg(F.avg("detected").alias("alert_rate"), F.count("*").alias("chunks")))
    families, hidden, budgets = {}, {}, {}
    for variant, names in (("full", every), (f"without {a.drop}", tuple(n for n in every if n != a.drop))):
        found, judge, _ = external.of_lenses(chunks, prof, names, a.far, a.bases)
        caught = detection.ensemble(found.detections)
        families[variant] = {r["family"]: r["k80"] for r in detection.smallest_caught(found.items, caught).collect()}  # a row per family
        got = attacks.hidden(judge, budget=a.budget) if judge and a.budget else {}
        hidden[variant] = {f: r["k_evade"] if (r["holds_up"] or 0) >= 0.5 else None for f, r in got.items()}
        if variant == "full" and judge:
            budgets = {b: {f: r["k_evade"] if (r["holds_up"] or 0) >= 0.5 else None for f, r in attacks.hidden(judge, budget=b).items()} for b in a.budgets or []}
    parts = {"variants": variants, "families": families, "hidden": hidden, "diagnostic": rows(drift.clock_diagnostic(s, a.drop, a.far, len(every))), "budgets": budgets}
    report(a.out, "ablation", reports.ablation(parts), **parts)
    return 0


def replay(spark, a) -> int:
    """A recorded incident before detectors calibrated on synthetic clean traces."""
    prof, names = lenses.Profile(), _names(a)
    clean = tables.written(attacks.synthetic(spark, a.traces))
    th = tables.written(stack.calibrate(stack.scores(lenses.series(clean, prof, names), clean, names), len(names), a.far))
    found = [r for n in a.path for r in rows(attacks.replayed(files.incident_phases(spark, n), prof, names, th, compress=a.compress))]
    report(a.out, "replay", reports.replay(found), incidents=found)
    return 0


def stale(spark, a) -> int:
    import numpy as np

    prof, names, rng = lenses.Profile(), _names(a), np.random.default_rng(1)
    versions = [("v0", prof)] + [(f"v{i}", drift.perturbed(prof, x, rng)) for i, x in enumerate(a.sizes or [0.2, 0.5], 1)]
    found = rows(drift.staleness(spark, versions, names, a.traces, max(10, a.traces // 2), a.far))
    shift = [{"version": n, **profile.behaviour_shift(prof, p)} for n, p in versions]
    report(a.out, "drift-sim", reports.staleness(found), staleness=found, shift=shift)
    return 0


def lineage(spark, a) -> int:
    verdict = weights.verify(weights.read_vector(spark, a.path), a.key.encode(), bytes.fromhex(a.signature))
    report(a.out, "weights", reports.lineage(verdict), verdict=verdict)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="watchgrid", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *options, path: bool = True, many_paths: bool = False):
        p = sub.add_parser(name)
        if path:
            p.add_argument("path", **({"nargs": "+"} if many_paths else {}))
        p.add_argument("--out", default="report")
        p.add_argument("--far", type=float, default=0.05)
        p.add_argument("--chunk", type=float, default=10_800.0)
        for flag, kw in options:
            p.add_argument(flag, **kw)
        p.set_defaults(run=run)

    text = {"default": None}
    many = {"action": "append"}
    quick, bases = ("--quick", {"action": "store_true"}), ("--bases", {"type": int, "default": external.BASES})
    budget = ("--budget", {"type": int, "default": 160})
    whole = (("--observed", text), ("--format", text), quick, bases)
    outside = (("--monitor", many), ("--command", many), ("--plugin", many), *whole)
    add("demo", audit, ("--path", text), ("--fuzz", {"type": int, "default": 150}), ("--budget", {"type": int, "default": 60}), quick, bases, path=False)
    add("audit", audit, ("--fuzz", {"type": int, "default": 150}), ("--budget", {"type": int, "default": 60}), *whole)
    add("curves", curves_command, *whole)
    add("audit-monitor", audit_monitor, *outside)
    add("gate", gate_command, ("--policy", text), ("--save-policy", text), ("--updates", text), ("--ledger", text), ("--witness", text), ("--step", {"default": "unnamed step"}), budget, *outside)
    add("updates", updates, ("--sla", {"type": float, "default": 24.0}), ("--fail", {"action": "store_true"}), ("--fail-if-behind", {"action": "store_true"}), ("--git", {"action": "store_true"}), ("--watch", many))
    add("updates-from-git", lambda s, a: updates(s, argparse.Namespace(**{**vars(a), "git": True})), ("--sla", {"type": float, "default": 24.0}), ("--fail", {"action": "store_true"}), ("--fail-if-behind", {"action": "store_true"}), ("--watch", many))
    add("channel", channel_command, ("--actions", text), ("--rounds", {"type": int, "default": 50}))
    for kind in ("transcript", "text-audit"):
        add(kind, transcripts, ("--monitor", many), ("--command", many), ("--least", {"type": float, "default": None}), ("--kind", {"default": kind}))
    add("tracelab", sessions_command, ("--group-by", {"default": "model"}), quick)
    add("drift", sessions_command, ("--group-by", {"default": "model"}), quick)
    add("ablate", ablate, ("--drop", {"default": "clock"}), ("--budgets", {"type": int, "nargs": "*"}), budget, *whole)
    add("reproduce", ablate, ("--drop", {"default": "clock"}), ("--budgets", {"type": int, "nargs": "*"}), budget, *whole)
    add("snapshot", lambda s, a: print(json.dumps(rows(files.snapshot(s, [a.path], 0.0)))) or 0)
    add("replay", replay, ("--traces", {"type": int, "default": 40}), ("--compress", {"type": float, "default": 1.0}), quick, many_paths=True)
    add("drift-sim", stale, ("--traces", {"type": int, "default": 40}), ("--sizes", {"type": float, "nargs": "*"}), quick, path=False)
    add("gate-verify", lambda s, a: print(json.dumps(state := gate.ledger_state(Path(a.path).read_text().splitlines(), a.witness))) or int(not state["ok"]), ("--witness", text))
    add("commit", lambda s, a: print(*commons.commit(Path(a.path).read_bytes())) or 0)
    add("reveal", lambda s, a: int(not commons.reveals(Path(a.path).read_bytes(), a.salt, a.digest)), ("--salt", {"required": True}), ("--digest", {"required": True}))
    add("weights-verify", lineage, ("--key", {"required": True}), ("--signature", {"required": True}))
    add("weights-sign", lambda s, a: weights.embed(weights.read_vector(s, a.path), a.key.encode(), bytes.fromhex(a.signature)).write.parquet(a.out) or 0, ("--key", {"required": True}), ("--signature", {"required": True}))
    a = top.parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    raise SystemExit(main())
