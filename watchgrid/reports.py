"""Reports in Markdown from small results, each with a sentence on what the numbers say. Rows are dictionaries, as Row.asDict gives them."""

from __future__ import annotations

from collections.abc import Iterable


def percent(x: float | None, places: int = 0) -> str:
    return "not known" if x is None else f"{100 * x:.{places}f} %"


def strength(k: float | None) -> str:
    return "none" if k is None else f"{k:.3g}"


def cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, float):
        return f"{x:.4g}"
    return ", ".join(map(cell, x)) if isinstance(x, list | tuple | set) else str(x).replace("|", "\\|").replace("\n", " ")


def table(rows: Iterable[dict], columns: list[str] | None = None, most: int = 200) -> list[str]:
    """A Markdown table; what goes beyond `most` rows is counted below it."""
    rows = list(rows)
    if not rows:
        return ["(none)"]
    columns = columns or list(rows[0])
    out = [f"| {' | '.join(columns)} |", f"|{'-|' * len(columns)}"] + [f"| {' | '.join(cell(r.get(c)) for c in columns)} |" for r in rows[:most]]
    return out + ([f"({len(rows) - most} more in the JSON file)"] if len(rows) > most else [])


def section(title: str, *parts: str | list[str]) -> list[str]:
    out = ["", f"## {title}", ""]
    for p in parts:
        out += p if isinstance(p, list) else [p, ""]
    return out


def document(title: str, *sections: list[str]) -> str:
    return "\n".join([f"# {title}", *(line for s in sections for line in s)]) + "\n"


def _curve_rows(curves: list[dict]) -> list[dict]:
    """A row per family and a column per strength."""
    ks = sorted({r["k"] for r in curves})
    by = {(r["family"], r["k"]): r["rate"] for r in curves}
    return [{"family": f, **{f"k = {k:g}": percent(by.get((f, k))) for k in ks}} for f in sorted({r["family"] for r in curves})]


def curves(found: list[dict]) -> str:
    late = sorted({r["family"] for r in found} - {r["family"] for r in found if r["rate"] >= 0.8})
    said = f"Not noticed in 80 % of the runs at any strength: {', '.join(late)}." if late else "Every family is noticed in 80 % of the runs from some strength on."
    return document("Detection by strength of attack", section("Share noticed", said, table(_curve_rows(found))), section("Counts and 95 % intervals", table(found)))


def audit(parts: dict) -> str:
    rate = parts["false_alarms"][0]["rate"] if parts["false_alarms"] else None
    sections = [
        section("False alarms", f"Of the later clean chunks {percent(rate, 1)} raise an alarm; {percent(parts['far'])} was aimed at.", table(parts["thresholds"])),
        section("Known attacks", table(parts["library"], ["attack", "harm", "detected", "fired", "margin"])),
        section("Random attacks", *[f"Of {r['n']} harmful ones {percent(r['coverage'])} are noticed (95 % interval {percent(r['low'])} to {percent(r['high'])})." for r in parts["fuzz"]]),
        section("Scaled attacks", table(_curve_rows(parts["curves"]))),
        section("An attacker who knows the scores", f"The most harmful attack found that nothing notices has a harm of {parts['adaptive']['undetected_harm']:.2f}, after {len(parts['adaptive']['history'])} tries."),
    ]
    return document("Audit of the detectors", *sections, section("Behaviour", table([parts["profile"]], ["rate", "active_frac", "ctrl_p", "win", "value_rho"])))


def _families(sensitivity: list[dict]) -> list[dict]:
    names = sorted({r["monitor"] for r in sensitivity})
    by = {(r["monitor"], r["family"]): r for r in sensitivity}
    return [{"family": f, **{n: strength(by[n, f]["k80"]) if (n, f) in by else "" for n in names}} for f in sorted({r["family"] for r in sensitivity})]


def _overlap(o: dict) -> list[str]:
    out = [f"{o['attacks']} attacks could be judged by all; {percent(o['caught_by_none'])} are caught by none, {percent(o['caught_by_exactly_one'])} of the caught by exactly one.", ""]
    if o["effective_monitors"] is not None:
        out += [f"The monitors count as {o['effective_monitors']:.2f} independent ones; groups that each catch what all catch: {len(o['groups'])}.", ""]
    if o["near_copies"]:
        out += [f"Counted as one: {'; '.join(' + '.join(c) for c in o['near_copies'])}.", ""]
    out += table([{"monitor": n, "adds": gain, "left without it": percent(o["without_one"].get(n))} for n, gain in o["order"]])
    return [*out, "", f"Correlation of misses {cell(o['failure_correlation']) or 'not known'}; share of caught attacks on which monitors disagree {percent(o['obstruction'])}."]


def monitors(parts: dict) -> str:
    noisy = [r["monitor"] for r in parts["false_alarms"] if r["low"] > parts["far"]]
    blind = sorted({r["monitor"] for r in parts["sensitivity"]} - {r["monitor"] for r in parts["sensitivity"] if r["caught"]})
    said = [f"Alarms on clean activity more often than aimed at: {', '.join(noisy)}." if noisy else "No monitor alarms on clean activity clearly more often than aimed at."]
    said += [f"Caught nothing: {', '.join(blind)}."] if blind else []
    return document(
        "Audit of monitors", section("Verdict", *said), section("Clean activity", table(parts["false_alarms"])), section("Thresholds", table(parts["thresholds"])),
        section("Smallest strength caught in 80 % of the runs", table(_families(parts["sensitivity"]))), section("Together", _overlap(parts["overlap"])),
    )


def gate(parts: dict) -> str:
    failed = [c["id"] for c in parts["criteria"] if c["status"] == "FAIL"]
    unknown = [c["id"] for c in parts["criteria"] if c["status"] == "UNKNOWN"]
    said = [f"Decision: **{parts['decision']}** for {parts['step']}."] + ([f"Failed: {', '.join(failed)}."] if failed else []) + ([f"Not known: {', '.join(unknown)}. What is not known does not pass."] if unknown else [])
    extra = [section("Adversary", table([{"family": f, **r} for f, r in parts["adversary"].items()], ["family", "k_evade", "holds_up", "queries"]))] if parts.get("adversary") else []
    return document("Gate", section("Decision", *said), section("Criteria", table(parts["criteria"])), *extra)


def staleness(rows: list[dict]) -> str:
    by = {(r["version"], r["thresholds"]): r for r in rows}
    changed = [{"version": v, "alarms, old thresholds": percent(by[v, "stale"]["alarm_rate"], 1), "alarms, own thresholds": percent(by[v, "fresh"]["alarm_rate"], 1), "caught, old": percent(by[v, "stale"]["coverage"]), "caught, own": percent(by[v, "fresh"]["coverage"])} for v in sorted({r["version"] for r in rows})]
    worst = max(rows, key=lambda r: r["alarm_rate"] or 0.0, default=None)
    return document("Staleness of thresholds", section("By version", f"Highest alarm rate on clean activity: {percent(worst['alarm_rate'], 1)} ({worst['version']}, {worst['thresholds']})." if worst else "No versions.", table(changed)))


def transfer(parts: dict) -> str:
    own = [r["rate"] for r in parts["transfer"] if r["a"] == r["b"]]
    other = [r for r in parts["transfer"] if r["a"] != r["b"]]
    broken = [r for r in other if own and r["low"] > max(own)]
    said = f"{len(broken)} of {len(other)} ordered pairs alarm clearly more often than any group under its own thresholds." if other else "There is one group."
    flagged = [r["block"] for r in parts.get("flagged", []) if r["flagged"]]
    return document(
        "Thresholds across groups and time", section("From group a to group b", said, table(parts["transfer"])),
        section("Within a group over time", f"Blocks above the shuffled control: {cell(flagged)}." if flagged else "No block is above the shuffled control.", table(parts["time"]), table(parts["control"])),
    )


def updates(parts: dict) -> str:
    counts: dict[str, int] = {}
    for f in parts["findings"]:
        counts[f["kind"]] = counts.get(f["kind"], 0) + 1
    pace = parts["pacing"]
    trend = {True: "Reviews are falling behind: the backlog grows.", False: "No growth of the backlog shows.", None: "The history is too short for a trend."}[pace.get("falling_behind")]
    return document("Accounting of changes", section("Findings", "Every change is declared, seen and reviewed." if not counts else "; ".join(f"{n} {k}" for k, n in sorted(counts.items())) + ".", table(parts["findings"])), section("Pace", trend, table([pace])))


def channel(parts: dict) -> str:
    said = f"{len(parts.get('lexicon', []))} tokens foretell an action." if "lexicon" in parts else "Without actions, messages cannot be held against what follows."
    pairs = [r for r in parts.get("coordination", []) if r.get("flagged")]
    more = [section("Tokens", said, table(parts.get("lexicon", [])))]
    if "coordination" in parts:
        more.append(section("Coordination", f"{len(pairs)} pairs of agents act together beyond their common load." if pairs else "No pair of agents acts together beyond its common load.", table(parts["coordination"])))
    if "informative" in parts:
        more.append(section("Whole messages", table(parts["informative"] if isinstance(parts["informative"], list) else [{"label": k, "value": v} for k, v in parts["informative"].items()] if isinstance(parts["informative"], dict) else [])))
    return document("Messages", section("Profile", table(parts["profile"])), section("Hidden characters", table(parts["hidden"]), table(parts["decoded"])), *more)


def texts(kind: str, parts: dict) -> str:
    missed = [r["monitor"] for r in parts["coverage"] if r["label"] == 1 and r["rate"] < 0.5]
    weak = [f"{r['monitor']} under {r['variant']}" for r in parts["text_audit"] if (r["still_caught"] is not None and r["still_caught"] < 0.8) or (r["flip_to_alarm"] or 0.0) > 0.05]
    said = [f"Catch less than half of the flagged texts: {', '.join(missed)}." if missed else "Every monitor catches half of the flagged texts or more."]
    said += [f"Verdicts that a rewrite changes: {'; '.join(weak)}." if weak else "No rewrite changes verdicts noticeably."]
    return document("Monitors of transcripts" if kind == "transcript" else "Monitors of texts", section("Verdict", *said), section("Coverage and false positives", table(parts["coverage"])), section("Rewrites", table(parts["stability"]), table(parts["text_audit"])), section("Correlations", table(parts["correlations"])))


def lineage(verdict: dict) -> str:
    return document("Lineage of parameters", section("Verdict", f"Lineage: {verdict['lineage']}; {percent(verdict.get('fraction'), 1)} of the signature's bits agree.", table([verdict])))


def ablation(parts: dict) -> str:
    rates = {r["variant"]: r["alert_rate"] for r in parts["variants"]}
    rows = [{"family": f, **{v: strength(parts["families"][v].get(f)) for v in parts["families"]}, **{f"hidden, {v}": strength(parts["hidden"][v].get(f)) for v in parts["hidden"]}} for f in sorted({f for x in parts["families"].values() for f in x})]
    curve = [section("Strongest hidden attack by query budget", table([{"budget": b, **x} for b, x in parts["budgets"].items()]))] if parts.get("budgets") else []
    return document("With and without a detector", section("Alarms on clean chunks", "; ".join(f"{v}: {percent(r, 1)}" for v, r in sorted(rates.items())) + "."), section("Smallest strength caught and strongest hidden", table(rows)), section("The detector itself", table(parts["diagnostic"])), *curve)


def replay(rows: list[dict]) -> str:
    said = [f"{r['attack']}: " + (f"noticed by {cell(r['fired'])} after {percent(r['share'])} of the incident." if r["detected"] else "not noticed.") for r in rows]
    return document("Replay of incidents", section("Outcome", *said), section("Details", table(rows)))
