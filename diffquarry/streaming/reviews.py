"""Structured Streaming forms of what is carried between runs: fingerprints seen, idempotent ingest, late feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.store import latest, upsert


def event_time(rows: DataFrame, column: str, late: str = "1 day") -> DataFrame:
    """rows with a watermark; a time without zone is taken as the session's."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def unseen_stream(rows: DataFrame, keys: list[str], column: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state of older keys is given up."""
    return event_time(rows, column, late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(rows: DataFrame, target: str, keys: list[str], newest: list[str], checkpoint: str) -> StreamingQuery:
    """Keep a table at target with the newest row of each key; each batch is written to a new version, then named.

    A batch that is run again writes the same version, so a retry replaces what it wrote before. A batch builds on the
    version before it, which must be there and complete; versions before that are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = latest(batch, keys, newest)
        if number:
            if not _exists(spark, f"{target}/v{number - 1}/_SUCCESS"):
                raise RuntimeError(f"version {number - 1} of {target} is absent or incomplete")
            now = upsert(spark.read.parquet(f"{target}/v{number - 1}"), now, keys)
        now.write.mode("overwrite").parquet(f"{target}/v{number}")
        for old in [v for v in _versions(spark, target) if v < number - 1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{old}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver(rows: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, failures: str) -> StreamingQuery:
    """Hand each batch of outcomes to send, in parts of a partition; what it raises is written to failures and the stream
    goes on, as a report that isn't delivered must not stop reviews."""

    def write(batch: DataFrame, number: int) -> None:
        columns = batch.columns

        def parts(it):
            for pdf in it:
                try:
                    send(pdf.to_dict("records"))
                    said = None
                except Exception as e:
                    said = f"{type(e).__name__}: {e}"[:240]
                yield pd.DataFrame({"batch": [number], "rows": [len(pdf)], "failure": [said]})

        batch.select(*columns).mapInPandas(parts, "batch long, rows long, failure string").write.mode("overwrite").parquet(f"{failures}/b{number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _versions(spark, target: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def newest_version(spark, target: str) -> DataFrame:
    """The newest version that is complete."""
    return spark.read.parquet(f"{target}/v{max(v for v in _versions(spark, target) if _exists(spark, f'{target}/v{v}/_SUCCESS'))}")


RESOLVED = "key string, fingerprint string, kind string, count int"


def feedback_stream(events: DataFrame) -> DataFrame:
    """(key, fingerprint, kind, count) of feedback whose finding was seen before or comes later.

    events: (key, fingerprint, kind, count); kind 'finding' says that a finding was posted. Feedback that comes first
    waits in the state of its key and fingerprint; a later count replaces an earlier one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, waiting = state.get if state.exists else (False, "")
        held = dict(x.split("=") for x in waiting.split(";") if x)
        out = []
        for pdf in batches:
            for r in pdf.itertuples():
                if r.kind == "finding":
                    seen = True
                else:
                    held[r.kind] = str(int(r.count_))
        if seen:
            out, held = [(key[0], key[1], k, int(n)) for k, n in sorted(held.items())], {}
        state.update((seen, ";".join(f"{k}={n}" for k, n in sorted(held.items()))))
        yield pd.DataFrame(out, columns=["key", "fingerprint", "kind", "count"])

    named = events.withColumnRenamed("count", "count_")
    return named.groupBy("key", "fingerprint").applyInPandasWithState(step, RESOLVED, "seen boolean, waiting string", "update", GroupStateTimeout.NoTimeout)
