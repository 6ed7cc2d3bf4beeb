"""Session helpers: lineage cuts, size-checked small sides, tables by name."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where it is unset."""
    sc = spark.sparkContext
    here = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not here:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        here = os.path.join(tempfile.gettempdir(), f"chronoraster-{sc.applicationId}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(here)
    return here


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table whose size is bounded by definition; more rows are an error."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows")
    return rows


MAX_BYTES = 64 << 20  # of a small side that is fetched and broadcast


def _wide(kind) -> bool:
    return kind.typeName() in ("array", "map", "struct")


def fetched(df: DataFrame, rows: int, size: int = MAX_BYTES):
    """``df`` as an Arrow table if it has at most ``rows`` rows and ``size`` bytes, else None.

    Rows of plain columns are fetched and measured.  With nested columns their
    elements are counted first, as a few rows could be large.
    """
    wide = [f.name for f in df.schema.fields if _wide(f.dataType)]
    first = df.limit(rows + 1)
    if wide:
        first = first.persist(StorageLevel.DISK_ONLY)
        try:
            each = sum((F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) if df.schema[c].dataType.typeName() != "struct" else F.lit(8) for c in wide), F.lit(0))
            most = first.agg(F.sum(each.cast("bigint") * 16)).first()[0] or 0
            table = first.toArrow() if most <= size else None
        finally:
            first.unpersist()
    else:
        table = first.toArrow()
    return table if table is not None and table.num_rows <= rows and table.nbytes <= size else None


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", bound: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Broadcast ``small`` when it has at most ``bound`` rows and ``MAX_BYTES`` bytes, else a shuffled join.

    Rows within the bounds are fetched for the check and sent out as they are, so
    that ``small`` is computed once.  ``keep``: how ``big`` is partitioned, and is
    to be partitioned again after a shuffled join.
    """
    rows = fetched(small, bound)
    if rows is not None:
        return big.join(F.broadcast(big.sparkSession.createDataFrame(rows, schema=small.schema)), on, how)
    out = big.join(small, on, how)
    return out.repartition(*keep) if keep else out


def settled(df: DataFrame, bound: int) -> DataFrame:
    """``df`` computed once, for use in several joins: fetched when it has at most ``bound`` rows and ``MAX_BYTES`` bytes, else written."""
    rows = fetched(df, bound)
    return df.sparkSession.createDataFrame(rows, schema=df.schema) if rows is not None else written(df, "settled")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared checkpoint folder and read back.

    For intermediate tables that several jobs read: columnar and compressed,
    without lineage.  The folder is removed when the application ends.
    """
    import uuid

    spark = df.sparkSession
    where = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    remove_at_end(spark, where)
    return spark.read.schema(df.schema).parquet(where)


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Remove an intermediate folder when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
