"""The command line into temporary folders."""

import json
import subprocess

import numpy as np

from watchgrid import cli
from watchgrid.sources.git import read_git


def lines(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    return str(path)


def test_updates_and_ledger(spark, tmp_path):
    rows = [{"type": "snapshot", "t": 0, "artifact": "f", "hash": "h0"}, {"type": "change", "t": 10, "artifact": "f", "old": "WRONG", "new": "h1"}, {"type": "odd"}]
    p = lines(tmp_path / "u.jsonl", rows)
    assert cli.main(["updates", p, "--out", str(tmp_path / "r"), "--fail"]) == 1
    got = json.loads((tmp_path / "r" / "updates.json").read_text())
    assert [f["kind"] for f in got["findings"]] == ["BROKEN_CHAIN"] and "BROKEN_CHAIN" in (tmp_path / "r" / "updates.md").read_text()


def events(n_days, rng):
    out = []
    for d in range(n_days):
        for _ in range(12):
            start = d * 86_400 + rng.uniform(0, 30_000)
            for t in np.sort(start + rng.uniform(0, 900, 40)):
                out.append({"t": float(t), "tool": str(rng.choice(["Read", "Edit", "Bash", "Grep", "WebFetch"])), "target": f"f{int(rng.integers(60))}", "size": float(rng.integers(1, 500))})
    return out


def test_gate_and_ledger(spark, tmp_path):
    p = lines(tmp_path / "e.jsonl", events(14, np.random.default_rng(1)))
    ledger = str(tmp_path / "ledger.jsonl")
    policy = str(tmp_path / "next.json")
    assert cli.main(["gate", p, "--out", str(tmp_path / "g"), "--ledger", ledger, "--step", "one", "--quick", "--bases", "4", "--budget", "20", "--save-policy", policy]) in (1, 3)
    assert cli.main(["gate-verify", ledger]) == 0
    row = json.loads((tmp_path / "ledger.jsonl").read_text())
    assert cli.main(["gate-verify", lines(tmp_path / "bad.jsonl", [{**row, "decision": "GO"}])]) == 1
    assert json.loads((tmp_path / "g" / "gate.json").read_text())["decision"] != "GO"
    told = {c["id"]: c for c in json.loads((tmp_path / "g" / "gate.json").read_text())["criteria"]}
    assert {"sensitivity:burst", "false_alarm", "redundancy"} <= set(told) and told["interface"]["status"] == "UNKNOWN"
    assert "not_gated" in json.loads((tmp_path / "next.json").read_text()) and "Decision: **" in (tmp_path / "g" / "gate.md").read_text()


def test_a_blind_monitor_is_told(spark, tmp_path):
    p = lines(tmp_path / "e.jsonl", events(14, np.random.default_rng(2)))
    (tmp_path / "mon.py").write_text("from collections import Counter\n\n\ndef busy(events):\n    return float(max(Counter(int(e['t'] // 10) for e in events).values()))\n\n\ndef blind(events):\n    return False\n")
    args = [p, "--monitor", f"{tmp_path}/mon.py:busy", "--monitor", f"{tmp_path}/mon.py:blind", "--quick", "--bases", "4"]
    assert cli.main(["audit-monitor", *args, "--out", str(tmp_path / "m")]) == 0
    got = json.loads((tmp_path / "m" / "monitors.json").read_text())
    caught = {(r["monitor"].split(":")[-1], r["family"]): r["caught"] for r in got["sensitivity"]}
    assert caught["busy", "burst"] > 0 and all(n == 0 for (m, _), n in caught.items() if m == "blind")
    assert "Caught nothing: " in (tmp_path / "m" / "monitors.md").read_text()


def test_curves_and_replay(spark, tmp_path):
    p = lines(tmp_path / "e.jsonl", events(10, np.random.default_rng(3)))
    assert cli.main(["curves", p, "--quick", "--bases", "3", "--out", str(tmp_path / "c")]) == 0
    assert {r["family"] for r in json.loads((tmp_path / "c" / "curves.json").read_text())["curves"]} >= {"burst", "loop", "odd_sequence"}
    assert cli.main(["replay", "miasma_2026_06", "--quick", "--traces", "10", "--out", str(tmp_path / "r")]) == 0
    assert json.loads((tmp_path / "r" / "replay.json").read_text())["incidents"][0]["attack"] == "miasma_2026_06"


def test_channel_and_transcripts(spark, tmp_path):
    m = lines(tmp_path / "m.jsonl", [{"t": i, "from": "a", "to": "b", "text": f"hello {i} w{i % 5}"} for i in range(60)])
    a = lines(tmp_path / "a.jsonl", [{"t": i + 0.5, "agent": "b", "tool": "read"} for i in range(0, 60, 2)])
    assert cli.main(["channel", m, "--actions", a, "--rounds", "5", "--out", str(tmp_path / "c")]) == 0
    (tmp_path / "mon.py").write_text("def score(text):\n    return float(text.count('bad'))\n")
    t = lines(tmp_path / "t.jsonl", [{"id": str(i), "text": "bad words" if i % 3 == 0 else f"fine {i}", "label": int(i % 3 == 0)} for i in range(30)])
    assert cli.main(["transcript", t, "--monitor", f"{tmp_path}/mon.py:score", "--out", str(tmp_path / "d"), "--least", "0.9"]) == 0
    cover = {r["label"]: r["rate"] for r in json.loads((tmp_path / "d" / "transcript.json").read_text())["coverage"]}
    assert cover == {0: 0.0, 1: 1.0}
    assert cli.main(["text-audit", t, "--monitor", f"{tmp_path}/mon.py:score", "--out", str(tmp_path / "e")]) == 0


def test_sessions(spark, tmp_path):
    rng = np.random.default_rng(2)
    tool = lambda t: {"tool_name": str(rng.choice(["Read", "Edit"])), "emitted_at": float(t), "input_chars": 5, "is_error": False}
    rows = [{"model": f"m{i % 2}", "session_id": f"s{i}", "tools": [tool(i * 90_000 + t) for t in np.sort(rng.uniform(0, 9000, 150))]} for i in range(16)]
    p = lines(tmp_path / "s.jsonl", rows)
    assert cli.main(["tracelab", p, "--out", str(tmp_path / "t")]) == 0
    got = json.loads((tmp_path / "t" / "tracelab.json").read_text())["transfer"]
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in ("m0", "m1") for b in ("m0", "m1")}


def test_commit_and_reveal(spark, tmp_path, capsys):
    f = tmp_path / "secret"
    f.write_bytes(b"x")
    cli.main(["commit", str(f)])
    digest, salt = capsys.readouterr().out.split()[-2:]
    assert cli.main(["reveal", str(f), "--salt", salt, "--digest", digest]) == 0
    f.write_bytes(b"y")
    assert cli.main(["reveal", str(f), "--salt", salt, "--digest", digest]) == 1


def test_git(spark, tmp_path):
    def git(*args, author="Ann <a@x>"):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *args], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "GIT_AUTHOR_NAME": author.split(" <")[0], "GIT_AUTHOR_EMAIL": author.split("<")[1][:-1], "HOME": str(tmp_path)})

    git("init", "-q")
    for i, who in enumerate(("Ann <a@x>", "agent-bot <b@x>")):
        (tmp_path / "rules.md").write_text(f"v{i}")
        git("add", "rules.md")
        git("commit", "-q", "-m", f"c{i}", author=who)
    got = [r["type"] for r in read_git(spark, str(tmp_path), ["rules.md"], now=2e9).orderBy("seq").collect()]
    assert got == ["change", "review", "change", "snapshot"]
