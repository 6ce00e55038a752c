"""What every query needs from the session: shipped code and shared storage.

Executors may not see the driver's folders, so the package itself is sent to
them once per application, and whatever must survive a lost executor is written
below ``spark.checkpoint.dir`` and read again.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_LOCK = threading.Lock()
_SHIPPED: set[str] = set()
_OWN_DIR: list[str] = []

#: Rows in an Arrow batch. Documents can be long, so this is below Spark's default of 10,000.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors (once per application) and bound Arrow batches."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _SHIPPED:
            root = Path(__file__).resolve().parent
            folder = tempfile.mkdtemp(prefix="sylvan-code-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            target = Path(folder) / "sylvan_code.zip"
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            spark.sparkContext.addPyFile(str(target))
            _SHIPPED.add(app)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where the cluster names none and is this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    if not _OWN_DIR:
        folder = tempfile.mkdtemp(prefix="sylvan-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_DIR.append("file://" + folder)
    return _OWN_DIR[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a
    lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylvan/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sylvan_path = path  # noqa: SLF001
    return back


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that tells its rows apart and is the same whenever the frame is read: the file and
    the place in it where the frame comes from files, else a number that is written once."""
    try:
        out = df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        out.schema  # noqa: B018  analysed here
    except AnalysisException:  # a frame that is not a scan of files
        out = materialise(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), "numbered")
    return out


def together(*makers: Callable[[], T]) -> list[T]:
    """What the makers return, in their order; their jobs run side by side, so that small ones don't wait in line."""
    with ThreadPoolExecutor(max(len(makers), 1)) as pool:
        return [x.result() for x in [pool.submit(m) for m in makers]]


def release() -> None:
    """Give a worker's free memory back: workers live on, and what the allocators keep adds up."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sylvan/{spark.sparkContext.applicationId}")  # noqa: SLF001
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that :func:`materialise` wrote and that no later plan reads."""
    for df in frames:
        path = getattr(df, "_sylvan_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
