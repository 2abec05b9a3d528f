"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir, written  # noqa: F401

#: A word is a maximal run of code points outside space and U+0009..U+000D. ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows an Arrow batch holds. Whole texts travel in these batches, so this bounds a Python worker's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to ``rows`` rows, as they carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_with_ids(rows: DataFrame, run: Callable, schema: str, *ids: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` in which the long columns ``ids``, of the input and of the output, travel as strings.

    pandas holds a long column with a null as doubles, which changes ids from 2^53 on.
    """
    sent = rows.withColumns({c: F.col(c).cast("string") for c in ids if c in rows.columns})
    for c in ids:
        schema = schema.replace(f"{c} long", f"{c} string")
    out = sent.mapInPandas(run, schema)
    return out.withColumns({c: F.col(c).cast("long") for c in ids if c in out.columns})


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as no column of that name (in any case) needs."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_ids(rows: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows in seeded hash order, so that the choice is the same in every run.

    They are written: collected at once, every partition would send its own first ``limit`` rows to the driver.
    """
    return written(rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(limit), "sample")
