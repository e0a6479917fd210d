"""Small helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import tune

MASK64 = (1 << 64) - 1
ARROW_ROWS = 1000
#: Rows of a few numbers that one task takes with ease.
TASK_ROWS = 250_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: skew handling, small Arrow batches, a checkpoint folder.

    The folder is the one in ``spark.checkpoint.dir``; only local sessions without one get a folder of their own.
    """
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = os.path.join(tempfile.gettempdir(), "corpus-checkpoints")
        context.setCheckpointDir(folder)
    return spark


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(rows: int) -> int:
    """Tasks for so many small rows: steps over little data then need no exchange between as many tasks as a large table does."""
    return max(1, -(-rows // TASK_ROWS))


def utf8(text: str | Column) -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(bytearray()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp prefix sums: entry ``i`` covers ``values[:i]``."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp hashes of the spans, the same wherever a span stands."""
    _, down = powers.upto(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]
