"""Spark sessions with the settings that the engine counts on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_PACKAGE = Path(__file__).resolve().parent.name
_shipped: set[str] = set()
#: Rows of a batch that a task turns into Python objects at a time.
SLICE = 64


def session(name: str = "lexforge", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword with ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession | None = None) -> None:
    """Make this package importable in Python workers.

    Where it is on PYTHONPATH already, nothing is done; else a zip of it is
    handed to the session, which every executor, late ones too, fetches.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    out = Path(tempfile.mkdtemp(prefix=f"{_PACKAGE}-zip-")) / f"{_PACKAGE}.zip"
    atexit.register(shutil.rmtree, out.parent, True)
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((_ROOT / _PACKAGE).rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))


def sliced(batches: Iterable, rows: int = SLICE) -> Iterator:
    """Arrow batches or arrays in slices: a batch itself has some 10000 rows, which as Python objects take many times its bytes."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.slice(a, rows)
