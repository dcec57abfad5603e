"""A plug-in: a shape of attack, a gate criterion, a loader and a monitor. Load it with `--plugin examples/plugin_example.py`."""

from watchgrid import model
from watchgrid.operators.gate import Criterion
from watchgrid.sources import files


def credential_probe(k, stats, spread):
    """Reads in quick succession, then one call out."""
    n = max(2, int(6 * k))
    return [i * spread for i in range(n + 1)], [model.READ] * n + [model.NET], [100.0] * (n + 1)


def has_canary(evidence, policy):
    found = bool(evidence.extra.get("canary"))
    return Criterion("canary", "PASS" if found else "UNKNOWN", detail="a canary was planted" if found else "no canary")


def register(api):
    api.add_attack("credential_probe", credential_probe, max_k80=4.0)
    api.add_criterion(has_canary)
    api.add_loader("csv", files.read_csv_events)
    api.add_monitor("rm", lambda events: any("rm" in str(e["target"]) for e in events))
