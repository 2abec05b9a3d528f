"""Sessions: settings that the operators rely on, and this package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / "kinfolio.zip"
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                for f in sorted(top.rglob("*.py")):
                    z.write(f, f.relative_to(top.parent))
            # kept: late executors fetch it from the driver
            kept = Path(tempfile.mkdtemp(prefix="kinfolio-code-")) / "kinfolio.zip"
            kept.write_bytes(path.read_bytes())
        spark.sparkContext.addPyFile(str(kept))
        _shipped.add(app)
    return spark


def session(name: str = "kinfolio", **conf: str) -> SparkSession:
    """A session with times in UTC and adaptive execution; ``conf`` adds to it."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())
