"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where it is unset, ``set_shared_dir`` has to name one; a folder of the driver's machine would be none for executors
    elsewhere, so there only a session that runs in one process gets one by itself.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _chosen.get("dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _chosen["dir"] = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
    return base.rstrip("/")


_chosen: dict[str, str] = {}


def set_shared_dir(uri: str) -> None:
    """The shared folder for sessions in which spark.checkpoint.dir is unset."""
    _chosen["dir"] = uri


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application (see ``release``)."""
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; results that still read it become invalid."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(conf).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_row_base() -> int:
    """First row number of this task: distinct for each partition, the same when the task is run again."""
    ctx = TaskContext.get()
    return (ctx.partitionId() if ctx else 0) << 33


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: What a Python process keeps from one task of a run to the next, by run.
held: dict[str, object] = {}


def mapped(df: DataFrame, function: Callable, schema, run_id: str | None = None) -> DataFrame:
    """df.mapInArrow in batches of bounded size, whatever the texts' lengths; a task's end gives free memory back.

    What a Python process holds for a run other than ``run_id`` is dropped first.

    Spark takes the bounds of batches from the session when it plans a query, so this sets them there (4 MB, 2,000
    rows), unless the session has bounds of its own.
    """
    conf = df.sparkSession.conf
    for key, value in _BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, value)

    def run(batches):
        import ctypes

        import pyarrow

        # The C library's allocator can be told to give memory back.
        pyarrow.set_memory_pool(pyarrow.system_memory_pool())
        for other in [r for r in held if r != run_id]:
            del held[other]
        yield from function(batches)
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(run, schema)


_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def text_slices(ids, texts, most: int = 500_000) -> Iterator[tuple[list, list[bytes]]]:
    """Arrow columns (ids, texts) as lists, texts in UTF-8, about ``most`` bytes of text at a time."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.binary())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most)))
        end = min(end, len(texts))
        yield ids.slice(start, end - start).to_pylist(), texts.slice(start, end - start).to_pylist()
        start = end


def open_write(uri: str):
    """An output stream on any store that pyarrow knows; ``uri`` has a scheme or is an absolute path."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(_plain(uri))
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def open_read(uri: str):
    """A file that can be read at any place."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(_plain(uri))
    return where.open_input_file(path)


def _plain(uri: str) -> str:
    """Hadoop writes file:/a for what others write file:///a."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
