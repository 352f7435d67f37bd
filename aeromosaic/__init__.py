"""Orthomosaics from aerial frames as Spark DataFrame jobs."""

import os
import shutil
import tempfile

_shipped = set()


def ship(spark):
    """Give the package to the session's Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="aeromosaic-"), "aeromosaic")
        context.addPyFile(shutil.make_archive(target, "zip", root, "aeromosaic"))
        _shipped.add(context.applicationId)
    return spark
