"""lectio: Spark-first analytics over large segmented text corpora."""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.1.0"
_shipped: set[str] = set()
#: Bytes of a batch of rows that goes to a Python worker, where the session keeps Spark's default: whole texts can be long.
BATCH_BYTES = 8 << 20


def ship(spark) -> None:
    """Send this package's code to the Python workers, once per application, and bound the batches they get.

    Workers that already have the package on their path are not affected by the code sent.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) in ("67108864b", "64MB", "64m"):
        spark.conf.set(limit, f"{BATCH_BYTES}b")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="lectio-code-"), "lectio_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lectio", os.path.relpath(path, top)))
    context.addPyFile(at)
    _shipped.add(context.applicationId)
