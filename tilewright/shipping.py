"""The package itself on the executors: a zip in the shared folder that Spark hands to every task, for clusters on which it isn't installed."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.state_io import file_system, scratch

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """The session, whose tasks can import this package from now on; once for each application. The driver's copy is what they get."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        at = f"{scratch(spark, 'package')}/{root.name}.zip"
        fs, p = file_system(spark, at)
        out = fs.create(p, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
    return spark
