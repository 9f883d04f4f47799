"""Session helpers: checkpoint folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast tables stay below this, as rows in memory.
MAX_BROADCAST_BYTES = 64 << 20
#: What a row takes in a broadcast relation besides its columns.
ROW_BYTES = 32


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Where it is unset, a run inside one machine gets a temporary folder, removed at its end; a
    cluster is refused, as its machines would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="provisio-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there; survives the loss of executors.

    The files go when the rows are no longer referred to, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows and takes few bytes, else leave the join to a shuffle.

    ``df`` should be materialised (``cut``): it is measured, up to just past the bound.
    """
    texts = [c for c, t in df.dtypes if t in ("string", "binary")]
    chars = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long"))
    rows, held = df.limit(max_rows + 1).agg(F.count("*"), chars).collect()[0]
    small = rows <= max_rows and rows * (ROW_BYTES + 16 * len(df.columns)) + (held or 0) <= MAX_BROADCAST_BYTES
    return F.broadcast(df) if small else df


def with_salt(df: DataFrame, key, salts: int, name: str = "_salt") -> DataFrame:
    """Spread rows of one join key over ``salts`` tasks by another column."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))


def over_salts(df: DataFrame, salts: int, name: str = "_salt") -> DataFrame:
    """The other side of ``with_salt``: every row once for each salt."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
