"""What the training-data operators share: word rules, the shared folder, written tables."""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a local master gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is unset; name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="diffquarry-")
    sc.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. by: a column that parts it.
    onto: a written table of these columns that df is added to."""
    spark = df.sparkSession
    path = onto.written_at if onto is not None else f"{shared_dir(spark)}/diffquarry/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("append" if onto is not None else "errorifexists").option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete what materialize() wrote, or a part of it, once nothing that is still to run reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at + part)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that have ended, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def kept() -> dict:
    """What this worker process keeps from task to task, as long as nothing is unpacked that send() sent: so a stage doesn't
    hold what an earlier one remembered. It hangs on a module of the process, as functions travel by value."""
    return vars(pickle).setdefault("_diffquarry_kept", {})


#: Parts, by a hash of the rows' key, that large tables are shuffled in one after the other.
SHUFFLED_PARTS = 2


def by_parts(df: DataFrame, hashed: str, f: Callable[[DataFrame, int], DataFrame], name: str, compression: str = "snappy") -> DataFrame:
    """f of each part of df and its number, one after the other, written to one table: so the shuffle files of one part alone stand
    on disk beside df. hashed: a column of hashes; equal ones are in one part."""
    made = None
    for part in range(SHUFFLED_PARTS):
        made = materialize(f(df.filter(F.pmod(F.col(hashed), F.lit(SHUFFLED_PARTS)) == part), part), name, compression, onto=made)
        free_shuffles(df.sparkSession)
    return made


def send(spark: SparkSession, value) -> Callable:
    """A function for executors that gives value, which they unpack once each; its classes travel by value with it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if not hasattr(held, "unpacked"):
            kept().clear()
            held.unpacked = pickle.loads(held.value)
        return held.unpacked

    return get


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column, lower: bool = True) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ as an array, A-Z lowered if asked; null text has none.

    One translate turns every separator into a space, so that split() takes its path without a regex.
    """
    source, target = (UPPER + BLANKS, LOWER + " " * 5) if lower else (BLANKS, " " * 5)
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), source, target), " "), lambda w: w != "")
