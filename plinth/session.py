"""Sessions, the shared checkpoint folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when it is measured to be no larger than this.
BROADCAST_BYTES = 32 << 20


def local_session(cores: int | None = None, name: str = "plinth") -> SparkSession:
    """A local session with the settings that the tests and the bench use; an active session is kept."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PLINTH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else a temporary one of a local master."""
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(set_by_cluster)
        return set_by_cluster
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plinth-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context, so that Python workers can import it wherever they run. Spark's own file
    server takes it from the driver; executors that join later fetch it as well."""
    sc = spark.sparkContext
    if getattr(sc, "_plinth_shipped", False):
        return
    root = Path(__file__).parent
    made = Path(tempfile.mkdtemp(prefix="plinth-")) / "plinth.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(made))
    atexit.register(shutil.rmtree, str(made.parent), ignore_errors=True)
    sc._plinth_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, which: Column) -> tuple[DataFrame, int]:
    """df, written to the shared folder, and how many of its rows `which` is true for, told by the job that writes it."""
    seen = Observation()
    written = cut(df.observe(seen, F.count_if(which).alias("n")))
    return written, seen.get["n"]


def _width(df: DataFrame) -> Column:
    """The bytes of a row, near enough: eight a value, and the lengths of texts and of what is nested."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    parts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in plain]
    parts += [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in nested]
    return sum(parts, F.lit(8 * len(df.columns)))


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """df, written to the shared folder, and its size in bytes, told by the job that writes it: it is computed once."""
    seen = Observation()
    written = cut(df.observe(seen, F.coalesce(F.sum(_width(df).cast("bigint")), F.lit(0)).alias("bytes")))
    return written, seen.get["bytes"]


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, measured, with a broadcast hint if it is no larger than `most` bytes, else without."""
    written, size = measured(df)
    return F.broadcast(written) if size <= most else written
