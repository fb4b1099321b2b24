"""Outputs of a run that become current together.

Every output is written aside, below ``<output>/_runs/<run>``. Then one small manifest is put there,
which is the commit: before it the old outputs stand whole, after it the new ones count. What the
manifest lists is moved to its place by renames; if the driver dies among them, ``recover`` (which
every run calls first) finishes them, and ``current_path`` finds each output meanwhile.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from histloom.operators import shared_files as fs

ASIDE = "_runs"
MANIFEST = "manifest.json"
OLD = "_old"


class Outputs:
    """The outputs of one run below ``output``."""

    def __init__(self, spark: SparkSession, output: str, run_id: str) -> None:
        self.spark, self.output = spark, output.rstrip("/")
        self.aside = f"{self.output}/{ASIDE}/{run_id}"
        self.written: list[str] = []

    def write(self, name: str, rows: Callable[[], DataFrame], text: bool = False) -> None:
        """Write an output aside as JSON lines, or its one column as text; a finished one stays."""
        path = f"{self.aside}/{name}"
        if not fs.complete(self.spark, path):
            writer = rows().write.mode("overwrite")
            writer.text(path) if text else writer.json(path)
        self.written.append(name)

    def publish(self, known: Iterable[str]) -> None:
        """Make what was written current; ``known`` outputs that this run does not have go."""
        gone = sorted(set(known) - set(self.written))
        manifest = f"{self.aside}/{MANIFEST}"
        if not fs.exists(self.spark, manifest):
            fs.write_text(self.spark, manifest, json.dumps({"outputs": self.written, "gone": gone}))
        _finish(self.spark, self.output, self.aside)

    def discard(self) -> None:
        """Remove what was written aside and is not committed."""
        if not fs.exists(self.spark, f"{self.aside}/{MANIFEST}"):
            fs.delete(self.spark, self.aside)


def _finish(spark: SparkSession, output: str, aside: str) -> None:
    """Move the outputs of a committed run to their places; may be repeated after any step."""
    manifest = json.loads(fs.read_text(spark, f"{aside}/{MANIFEST}"))
    for name in manifest["outputs"] + manifest["gone"]:
        new, place, old = f"{aside}/{name}", f"{output}/{name}", f"{aside}/{OLD}/{name}"
        pending = name in manifest["gone"] or fs.exists(spark, new)
        # An output that is not aside any more is in its place already.
        if pending and fs.exists(spark, place):
            fs.delete(spark, old)
            fs.move(spark, place, old)
        if name in manifest["outputs"] and pending:
            fs.move(spark, new, place)
    fs.delete(spark, aside)


def _committed(spark: SparkSession, output: str) -> list[str]:
    runs = f"{output.rstrip('/')}/{ASIDE}"
    found = (f"{runs}/{name}" for name in fs.folders(spark, runs))
    return [aside for aside in found if fs.exists(spark, f"{aside}/{MANIFEST}")]


def recover(spark: SparkSession, output: str) -> int:
    """Finish committed runs whose driver died while their outputs were moved; returns how many.

    Only one run may write to ``output`` at a time, so there is at most one.
    """
    found = _committed(spark, output)
    for aside in found:
        _finish(spark, output.rstrip("/"), aside)
    return len(found)


def current_path(spark: SparkSession, output: str, name: str) -> str:
    """Where the current output ``name`` is, also between a commit and the last of its moves."""
    for aside in _committed(spark, output):
        if fs.exists(spark, f"{aside}/{name}"):
            return f"{aside}/{name}"
    return f"{output.rstrip('/')}/{name}"
