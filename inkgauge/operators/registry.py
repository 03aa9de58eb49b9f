"""Detectors by name, so that a corpus can also be scored by detectors of one's own.

A detector takes parsed rows and returns them with `<name>_score` and `<name>_confidence`. Those written in Python come
in as a function of one text and run as an Arrow-batched UDF, whose failures become a score of 0 and a reason.
"""

from __future__ import annotations

import importlib.util
import logging
import sys
from collections.abc import Callable
from importlib import metadata
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detectors as D

log = logging.getLogger(__name__)
Detector = Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self, ranks: dict[str, int]):
        self.known: dict[str, tuple[str, Detector]] = {
            "classical": ("classical", lambda d: D.classical(d, ranks)),
            "stylometric": ("stylometric", D.stylometric),
            "statistical": ("watermark", lambda d: D.statistical(d, ranks)),
        }
        self.built_in = frozenset(self.known)

    def register(self, name: str, detector: Detector, family: str = "classical", override: bool = False) -> None:
        if name in self.known and not override:
            raise ValueError(f"there is a detector named {name}")
        self.known[name] = (family, detector)

    def register_function(self, name: str, score: Callable[[str], float], family: str = "classical") -> None:
        """A detector of a Python function: 0 to 1 for a text. It has a confidence of 0.5, or 0 where it fails."""

        @F.pandas_udf("struct<score: double, error: string>")
        def scored(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                try:
                    rows.append((min(1.0, max(0.0, float(score(t or "")))), None))
                except Exception as e:  # a detector of one's own may fail on a text; the others go on
                    rows.append((0.0, f"{type(e).__name__}: {e}"[:200]))
            return pd.DataFrame(rows, columns=["score", "error"])

        def run(d: DataFrame) -> DataFrame:
            r = F.col("__r")
            return (
                d.withColumn("__r", scored("raw")).withColumn(f"{name}_score", r["score"]).withColumn(f"{name}_error", r["error"])
                .withColumn(f"{name}_confidence", F.when(r["error"].isNull(), 0.5).otherwise(0.0)).drop("__r")
            )

        self.register(name, run, family)

    def load_entry_points(self, group: str = "inkgauge.detectors") -> None:
        """Installed detectors; they never replace built-in ones, and broken ones are left out."""
        for e in metadata.entry_points(group=group):
            if e.name in self.built_in:
                continue
            try:
                self.known[e.name] = ("classical", e.load())
            except Exception as x:  # a broken plug-in must not stop the others
                log.warning("detector %s can't be loaded: %s", e.name, x)

    def load_folder(self, spark: SparkSession, folder: str | Path) -> list[str]:
        """Detectors of a folder's modules (*.py but _*.py), which are run here and shipped to the executors; their names.

        A module tells them in DETECTORS, a list of functions of one text or of classes with a method score(text), or as a class
        Plugin; an attribute `name` goes before the function's or class's own name, `family` tells the family. Left out, with a warning: a
        folder that isn't there, a module that fails or is named like one that is installed, a built-in detector's name, what can't be called.
        Only give folders whose code you trust.
        """
        found = []
        if not Path(folder).expanduser().is_dir():
            log.warning("no folder of detectors %s", folder)
            return found
        for path in sorted(Path(folder).expanduser().glob("[!_]*.py")):
            module = None
            try:
                # A function is sent by its module's name, so that must mean the same module on every executor.
                if path.stem in sys.modules or importlib.util.find_spec(path.stem):
                    raise ImportError("a module of that name is installed")
                spec = importlib.util.spec_from_file_location(path.stem, path)
                module = sys.modules[path.stem] = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                told = [*getattr(module, "DETECTORS", []), *([module.Plugin] if hasattr(module, "Plugin") else [])]
                scores = {(getattr(x, "name", None) or x.__name__).lower(): (x().score if isinstance(x, type) else x, getattr(x, "family", "classical")) for x in told}
                spark.sparkContext.addPyFile(str(path))
            except (Exception, SystemExit) as x:  # a broken module must not stop the others, nor this process
                log.warning("detectors of %s can't be loaded: %s", path, x)
                if module is not None:
                    del sys.modules[path.stem]
                continue
            for name, (score, family) in scores.items():
                if name in self.built_in or not callable(score):
                    log.warning("detector %s of %s is left out", name, path)
                    continue
                self.known.pop(name, None)
                self.register_function(name, score, family)
                found.append(name)
        return found

    def create(self, name: str) -> Detector:
        if name not in self.known:
            raise KeyError(f"no detector {name}; there are {', '.join(sorted(self.known))}")
        return self.known[name][1]

    def create_many(self, names: list[str]) -> dict[str, Detector]:
        """Those of names that are known; the others are told and left out."""
        for n in names:
            if n not in self.known:
                log.warning("no detector %s", n)
        return {n: self.known[n][1] for n in names if n in self.known}

    def detect(self, parsed: DataFrame, names: list[str]) -> DataFrame:
        found = self.create_many(names)
        for detector in found.values():
            parsed = detector(parsed)
        return D.ensemble(parsed, members=list(found))
