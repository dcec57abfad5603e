"""Plug-ins: a module with register(api) adds attack shapes, gate criteria, loaders and monitors."""

from __future__ import annotations

import importlib
import importlib.util
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.operators import attacks, gate, texts
from watchgrid.sources import files

MONITORS: dict = {}


class Api:
    def add_attack(self, name: str, shape, max_k80: float = 8.0) -> None:
        attacks.SHAPES[name] = shape
        gate.DEFAULT_POLICY["max_k80"][name] = max_k80

    def add_criterion(self, criterion) -> None:
        gate.EXTRA.append(criterion)

    def add_loader(self, name: str, loader) -> None:
        files.LOADERS[name] = loader

    def add_monitor(self, name: str, monitor) -> None:
        MONITORS[name] = monitor


def _module(spec: str):
    if spec.endswith(".py"):
        found = importlib.util.spec_from_file_location(Path(spec).stem, spec)
        module = importlib.util.module_from_spec(found)
        found.loader.exec_module(module)
        return module
    return importlib.import_module(spec)


def load(spec: str) -> None:
    """Loads a plug-in from a module name or a file."""
    module = _module(spec)
    if not hasattr(module, "register"):
        raise ValueError(f"{spec} has no register(api)")
    module.register(Api())


def monitor(spec: str):
    """A function from 'module:function' or 'file.py:function'."""
    module, _, name = spec.rpartition(":")
    if not module:
        raise ValueError("use module:function or file.py:function")
    return getattr(_module(module), name)


def event_monitor(traces: DataFrame, function) -> DataFrame:
    """(trace_id, score) of a Python function over each trace's reported events, a list of dictionaries in order of time. A trace is what one call sees, so it meets in one task."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["t", "seq"]).to_dict("records")
        return pd.DataFrame({"trace_id": [pdf["trace_id"].iloc[0]], "score": [float(function(rows))]})

    return traces.where("chan = 0").groupBy("trace_id").applyInPandas(run, "trace_id long, score double")


def command_event_monitor(traces: DataFrame, command: str, timeout: float = 180.0) -> DataFrame:
    """The same with a command that reads events as JSON lines; a failing one raises."""
    import json
    import shlex
    import subprocess

    def call(rows: list[dict]) -> float:
        lines = "\n".join(json.dumps({k: (None if v != v else v) for k, v in r.items()}) for r in rows)
        done = subprocess.run(shlex.split(command), input=lines, capture_output=True, text=True, timeout=timeout, check=True)
        score = texts.verdict(done.stdout)
        if score is None:
            raise ValueError(f"no verdict in {done.stdout[:100]!r}")
        return score

    return event_monitor(traces, call)


def sensitive_writes(traces: DataFrame) -> DataFrame:
    """A native monitor as an example: control-file writes count 5, outbound bytes 1 per 100,000."""
    from watchgrid import model

    hit = (F.col("kind") == model.WRITE) & (F.col("target") < model.N_CONTROL)
    return traces.where("chan = 0").groupBy("trace_id").agg((F.sum(F.when(hit, 5.0).otherwise(0.0)) + F.sum(F.when(F.col("kind") == model.NET, F.col("size")).otherwise(0.0)) / 1e5).alias("score"))
