"""Session settings, table access and reliable checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Semantics the engine relies on; everything about resources is left to the cluster.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests, the command line and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessella")
    defaults = {
        **SEMANTICS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    session on a single machine that names none gets a temporary folder of its own,
    since executors elsewhere could not read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = _temporary("checkpoint")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _temporary(name: str) -> str:
    """A folder on this machine that is removed when the process ends."""
    folder = tempfile.mkdtemp(prefix=f"tessella-{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of which nothing is read any more, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table to be written, in the shared folder of the cluster or, on one machine without one, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{_temporary('scratch')}/{name}"


def partitions_of(df: DataFrame) -> int:
    """In how many partitions a DataFrame comes, found without running more of it than tables to be broadcast.

    A plan with shuffles comes in as many as the widest of them makes, or fewer.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"(?<!Broadcast)Exchange (?:SinglePartition|\w+\((?:.*, )?(\d+)\))", plan)
    return max(int(n or 1) for n in shuffles) if shuffles else df.rdd.getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    Only an input that is read in fewer partitions than that, and is small for it, is
    shuffled; a large one, or one that comes from a shuffle, stays where it is. Meant for
    work that costs far more per row than moving the row does.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if partitions_of(df) < cores else df


def apply_semantics(spark: SparkSession) -> None:
    """Set what the engine relies on in a session that was made elsewhere."""
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let every executor import this package, wherever it was imported from here.

    The package's files are handed to Spark as one archive, which it serves to executors
    itself, once for each application. Where executors have the package anyway, this
    changes nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(_temporary("package"), "tessella_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
