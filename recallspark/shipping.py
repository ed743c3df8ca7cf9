"""Brings this package to the executors, which need it to run the operators' Python functions."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ship(of: SparkSession | DataFrame) -> None:
    """Once an application: adds the package to the Python files of its context. Nothing if it is loaded from an archive, which was shipped."""
    context = (of.sparkSession if isinstance(of, DataFrame) else of).sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _done or not os.path.isdir(here):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="recallspark-")), "recallspark-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _done.add(context.applicationId)
