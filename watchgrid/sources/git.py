"""Update records from a git repository: a change for each commit that alters a watched path, a review where someone else than an agent wrote it or a trailer says so."""

from __future__ import annotations

import hashlib
import re
import subprocess
import time

from pyspark.sql import DataFrame, SparkSession

from watchgrid import model


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def state_of(entries: list[tuple[str, str]]) -> str:
    """16 hex digits over sorted (name, blob) pairs; 'absent' without any."""
    return hashlib.sha256("".join(f"{n}\0{b}" for n, b in sorted(entries)).encode()).hexdigest()[:16] if entries else "absent"


def _committed(repo: str, commit: str, path: str) -> str:
    rows = _git(repo, "ls-tree", "-r", commit, "--", path).splitlines()
    return state_of([(r.split("\t", 1)[1], r.split()[2]) for r in rows])


def _working(repo: str, path: str) -> str:
    names = [n for n in _git(repo, "ls-files", "-co", "--exclude-standard", "--", path).splitlines() if n]
    return state_of([(n, _git(repo, "hash-object", "--", n).strip()) for n in names])


def read_git(spark: SparkSession, repo: str, paths: list[str], agent: str = "(?i)bot|agent|claude|copilot", trailer: str = "Reviewed-by", since: str | None = None, now: float | None = None) -> DataFrame:
    """Change, review and snapshot records of the watched paths along the first parents. History is read on the driver, one call per commit and path."""
    args = ["log", "--first-parent", "--reverse", "--format=%H%x1f%ct%x1f%an <%ae>%x1f%B%x1e", *([f"--since={since}"] if since else [])]
    rows, known = [], {}
    for entry in filter(str.strip, _git(repo, *args).split("\x1e")):
        commit, t, author, body = entry.strip("\n").split("\x1f")
        for path in paths:
            state, before = _committed(repo, commit, path), known.get(path)
            if state != (before or "absent"):
                rows.append(("change", float(t), path, before, state, None, author, None, None, None))
                if not re.search(agent, author) or re.search(rf"(?im)^{re.escape(trailer)}:", body):
                    rows.append(("review", float(t), path, None, state, None, None, None, author, "pass"))
            known[path] = state
    at = time.time() if now is None else now
    rows += [("snapshot", at, p, None, None, _working(repo, p), None, None, None, None) for p in paths]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], model.UPDATE_SCHEMA + ", seq long")
