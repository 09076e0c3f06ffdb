"""Tables written into the folder that all executors share, to cut lineage without local state."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only in local mode may it be unset: a temporary folder then stands in."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="llm-stage-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once for each Spark application; an installed or PYTHONPATH copy does no harm."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        out = Path(tempfile.mkdtemp(prefix="llm-code-")) / "training_operators.zip"
        with zipfile.ZipFile(out, "w") as z:
            package = Path(__file__).resolve().parent
            z.write(package.parent / "__init__.py", str((package.parent / "__init__.py").relative_to(root)))
            for p in sorted(package.glob("*.py")):
                z.write(p, str(p.relative_to(root)))
        sc.addPyFile(str(out))
        _SHIPPED.add(sc.applicationId)


_WRITTEN: list[str] = []


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder, and read again: a lost executor costs a reread, not a recomputation."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """What is written inside is deleted at the end, but for the last keep tables; only for results that are written inside themselves."""
    first = len(_WRITTEN)
    try:
        yield
        stop = len(_WRITTEN) - keep
    except BaseException:
        stop = len(_WRITTEN)
        raise
    finally:
        clean(spark, first, stop)


def clean(spark: SparkSession, first: int = 0, stop: int | None = None) -> None:
    """Delete the tables that this process has written in the shared folder (of those from first to stop); results that read them are void."""
    for path in _WRITTEN[first:stop]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[first:stop]


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets of a blob exchange: the session's shuffle partitions, which the operator of a cluster sizes to its data."""
    ship(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SOLE: dict[Hashable, Any] = {}


def sole(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one large object that a Python worker keeps from task to task. Asking for another drops it, so stages of one session do not add up."""
    if key not in _SOLE:
        drop()
        _SOLE[key] = make()
    return _SOLE[key]


def drop() -> None:
    """In a Python worker: let go of what another operator's tasks have left, and give unused memory back."""
    import contextlib
    import ctypes

    import pyarrow as pa

    _SOLE.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
