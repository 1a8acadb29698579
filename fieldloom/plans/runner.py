"""A small runner of dependent steps: order from inputs and outputs, checks, a manifest after every step, resumable.

A step is a function of (spark, {name: path}) that writes the paths of its outputs. Steps that fail, or whose outputs are
missing afterwards, end the run; what was recorded stays.
"""

from __future__ import annotations

import datetime as dt
import platform
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

import pyspark
from pyspark.sql import DataFrame, SparkSession

from fieldloom.sources.files import delete_outputs, exists

MANIFEST = "step_number int, step_id string, start_time timestamp, end_time timestamp, elapsed_seconds double, success boolean, missing_outputs string, message string"


class StepError(RuntimeError):
    pass


@dataclass(frozen=True)
class Step:
    id: str
    run: Callable[[SparkSession, dict[str, str]], None]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


@dataclass
class Runner:
    spark: SparkSession
    root: str
    steps: list[Step]
    external: dict[str, str] = field(default_factory=dict)
    records: list[tuple] = field(default_factory=list)

    def path(self, name: str) -> str:
        return self.external.get(name, f"{self.root.rstrip('/')}/{name}")

    def order(self) -> list[Step]:
        """Steps in an order in which every input is there; ties keep the given order."""
        makers: dict[str, str] = {}
        for s in self.steps:
            for o in s.outputs:
                if o in makers:
                    raise StepError(f"{o} is made by {makers[o]} and {s.id}")
                makers[o] = s.id
        by_id = {s.id: s for s in self.steps}
        if len(by_id) != len(self.steps):
            raise StepError("two steps have one id")
        for s in self.steps:
            if lost := [i for i in s.inputs if i not in makers and i not in self.external]:
                raise StepError(f"{s.id}: nothing makes {', '.join(lost)}")
        graph = {s.id: {makers[i] for i in s.inputs if i in makers} for s in self.steps}
        place = {s.id: k for k, s in enumerate(self.steps)}
        sorter = TopologicalSorter(graph)
        sorter.prepare()
        out: list[Step] = []
        ready: list[str] = []
        while sorter.is_active():
            ready = sorted([*ready, *sorter.get_ready()], key=place.get)
            out.append(by_id[ready[0]])
            sorter.done(ready.pop(0))
        return out

    def missing(self, names) -> list[str]:
        return [n for n in names if not exists(self.spark, self.path(n))]

    def preflight(self) -> None:
        if lost := self.missing(self.external):
            raise StepError(f"missing inputs: {', '.join(lost)}")

    def clean(self) -> list[str]:
        return delete_outputs(self.spark, self.root, [o for s in self.steps for o in s.outputs])

    def run(self, first: str | None = None, last: str | None = None, resume: bool = False) -> DataFrame:
        """Runs steps from first to last; with resume, a step all of whose outputs are there is passed over."""
        self.preflight()
        steps = self.order()
        ids = [s.id for s in steps]
        for named in (first, last):
            if named is not None and named not in ids:
                raise StepError(f"no step {named!r}")
        chosen = steps[ids.index(first) if first else 0 : ids.index(last) + 1 if last else None]
        for s in chosen:
            if resume and s.outputs and not self.missing(s.outputs):
                continue
            began, clock, message = dt.datetime.now(), time.monotonic(), None
            try:
                if lost := self.missing(s.inputs):
                    raise StepError(f"missing inputs: {', '.join(lost)}")
                s.run(self.spark, {n: self.path(n) for n in (*s.inputs, *s.outputs)})
            except Exception:  # recorded, then told below
                message = traceback.format_exc()
            lost = self.missing(s.outputs) if message is None else []
            ok = message is None and not lost
            self.records.append((len(self.records) + 1, s.id, began, dt.datetime.now(), time.monotonic() - clock, ok, ", ".join(lost) or None, message))
            self.write_manifest()
            if not ok:
                raise StepError(f"{s.id} failed: " + (self.log_tail() or f"missing outputs: {', '.join(lost)}"))
        return self.manifest()

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame(self.records, MANIFEST)

    def log_tail(self, lines: int = 50) -> str:
        """The last lines of the last step's message, as a failed run shows them."""
        return "\n".join((self.records[-1][-1] or "").splitlines()[-lines:]) if self.records else ""

    def write_manifest(self) -> None:
        self.manifest().coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{self.root.rstrip('/')}/run_manifest")

    def environment(self) -> DataFrame:
        facts = {"python": platform.python_version(), "pyspark": pyspark.__version__, "spark": self.spark.version, **{k: v for k, v in self.spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}}
        return self.spark.createDataFrame(sorted(facts.items()), "name string, value string")
