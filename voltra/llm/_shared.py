"""Helpers the corpus operators share: written intermediate tables and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text one vectorised pass works on; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``, or (unset, on one machine) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        path = _OWN["dir"] = tempfile.mkdtemp(prefix="voltra-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voltra-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def texts_only(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the text (null: empty), whatever else the table holds."""
    return docs.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col("text"), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"{base}{i or ''}" for i in range(len(taken) + 1)) if n.lower() not in taken) for base in names]


def by_bytes(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Slice Arrow batches so each slice holds about ``limit`` bytes of ``column`` (one row at least)."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        off = string_offsets(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < n:
            stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


def string_offsets(arr: pa.Array):
    """Byte offsets (length n+1) of a string array without nulls."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def string_bytes(arr: pa.Array):
    """(uint8 data, offsets from 0) of a string array without nulls."""
    import numpy as np

    off = string_offsets(arr)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]
