"""Schemas and fixed values of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Kinds of events, files that control an agent, hints that a path is one of them, tools by kind, commands that run tests.
KINDS = ("read", "write", "bash", "search", "test", "net")
READ, WRITE, BASH, SEARCH, TEST, NET = range(6)
CONTROL_FILES = ("AGENTS.md", "CLAUDE.md", ".claude/settings.json", ".cursor/rules", ".gemini/settings.json", ".vscode/tasks.json", ".github/workflows")
CONTROL_HINTS = (
    ("agents.md", 0), ("claude.md", 1), (".claude/", 2), ("skills/", 2), ("hooks", 2), (".cursor/", 3), ("cursorrules", 3), (".gemini/", 4), ("gemini.md", 4), (".vscode/tasks", 5),
    (".github/workflows", 6),
)
TOOL_KINDS = {
    "Read": "read", "Glob": "search", "Grep": "search", "LS": "search", "Write": "write", "Edit": "write", "MultiEdit": "write", "NotebookEdit": "write", "Bash": "bash", "WebFetch": "net",
    "WebSearch": "net",
}
TEST_COMMANDS = ("pytest", "unittest", "npm test", "cargo test", "go test")
N_CONTROL, N_FILES = len(CONTROL_FILES), 300

#: Trace events: one row per event, trace_id for what is judged as one; chan 0 was reported by the agent, 1 recorded independently; value is null where there is none.
TRACE_SCHEMA = "trace_id long, seq long, t double, agent int, kind int, target int, size double, value double, chan int"
UPDATE_SCHEMA = "type string, t double, artifact string, old string, new string, hash string, actor string, kind string, by string, result string"
MESSAGE_SCHEMA = "msg_id long, t double, sender string, receiver string, text string"
ACTION_SCHEMA = "t double, agent string, label string"

#: Ordered patterns of the drift detectors, over kinds and writes to control files ("ctrl", code 6).
TEMPLATES = {
    "drift_tamper_exfil": ("ctrl", "ctrl", "net"),
    "drift_recon_exfil": ("search", "read", "read", "read", "net"),
    "drift_chain": ("search", "read", "bash", "ctrl", "net"),
}
TOKENS = {**{k: i for i, k in enumerate(KINDS)}, "ctrl": 6}

# Fixed values of the default behaviour profile: shares of kinds, and weights of what follows what.
_SHARES = (0.45, 0.12, 0.18, 0.10, 0.10, 0.05)
_FOLLOWS = (
    (0.55, 0.12, 0.10, 0.10, 0.08, 0.05),
    (0.25, 0.20, 0.15, 0.05, 0.30, 0.05),
    (0.30, 0.15, 0.30, 0.05, 0.15, 0.05),
    (0.50, 0.05, 0.10, 0.25, 0.05, 0.05),
    (0.20, 0.35, 0.15, 0.10, 0.15, 0.05),
    (0.40, 0.10, 0.20, 0.10, 0.10, 0.10),
)


def _normal(row) -> tuple[float, ...]:
    return tuple(x / sum(row) for x in row)


@dataclass(frozen=True)
class Profile:
    """Behaviour of an agent: a few numbers that the driver may hold."""

    p_kind: tuple[float, ...] = field(default=_normal(_SHARES))
    trans: tuple[tuple[float, ...], ...] = field(default=tuple(_normal(r) for r in _FOLLOWS))
    rate: float = 0.4
    active_frac: float = 0.35
    ctrl_p: float = 0.002
    size_mu: float = 6.0
    size_sd: float = 1.0
    net_mu: float = 8.0
    value_mu: float = 85.0
    value_sd: float = 6.0
    drop: float = 0.005
    win: float = 300.0
    value_rho: float = 0.0


DEFAULT_PROFILE = Profile()
