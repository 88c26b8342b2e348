"""Tables between steps, in the folder that all executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset: a local one, only if all runs in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "/tmp/pointloom-checkpoints"
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later steps start from there, also when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/pointloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _add_vectors(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    parts: dict = {}
    for batch in batches:
        for s, x in zip(batch.column("segment").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(x), "<u8")
            parts[s] = parts[s] + own if s in parts else own
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], ["segment", "cells"])


def summed_vectors(rows: DataFrame, lanes: int = 16) -> dict:
    """Sums of vectors of 64-bit counts by segment, first by lane and then over all; for vectors of a fixed size."""
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    kind = "segment int, cells binary"
    partial = rows.withColumn("lane", F.pmod(F.xxhash64("cells"), F.lit(lanes))).repartition("segment", "lane").select("segment", "cells").mapInArrow(_add_vectors, kind)
    return {r.segment: np.frombuffer(zlib.decompress(r.cells), "<u8") for r in partial.repartition("segment").mapInArrow(_add_vectors, kind).collect()}
