"""Page events of jobs as streams: once-only delivery, job state with replay, and front-matter suppression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import work_path

EVENT = "job string, page int, page_count int, event string, text string"


def read_events(spark: SparkSession, path: str, schema: str | T.StructType = EVENT, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(events: DataFrame) -> DataFrame:
    """Each page of a job once, however often it is sent again."""
    return events.dropDuplicates(["job", "page"])


def _suppress(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    active, target = state.get if state.exists else (False, 0)
    rows = pd.concat(list(batches)).sort_values("page")
    out = []
    for r in rows.itertuples(index=False):
        text = (r.text or "").strip()
        lines = [x for x in text.splitlines() if x.strip()]
        entries = [int(x.split()[-1]) for x in lines if x.split() and x.split()[-1].isdigit()]
        begins = any(x.strip().lower() in ("contents", "table of contents") for x in lines)
        if begins and not active:
            active, target = True, min([e for e in entries if e > r.page], default=0)
        elif active and ((target and r.page >= target) or len(entries) < 3):
            active = False
        out.append((r.job, r.page, active))
    state.update((bool(active), int(target)))
    yield pd.DataFrame(out, columns=["job", "page", "suppressed"])


def suppress_contents(events: DataFrame) -> DataFrame:
    """job, page, suppressed: pages from a contents heading on, until its first destination or a page unlike contents.

    The state is the active flag and the destination, per job; it carries over batches.
    """
    return events.groupBy("job").applyInPandasWithState(_suppress, "job string, page int, suppressed boolean", "active boolean, target int", "append", GroupStateTimeout.NoTimeout)


def _job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, total, ended = state.get if state.exists else (0, 0, False)
    rows = pd.concat(list(batches))
    seen += int((rows["event"] == "page").sum())
    total = max(total, int(rows["page_count"].fillna(0).max()))
    ended = bool(ended or rows["event"].isin(["result", "error"]).any())
    state.update((seen, total, ended))
    yield pd.DataFrame([(key[0], seen, total, ended)], columns=["job", "pages", "page_count", "ended"])


def job_progress(events: DataFrame) -> DataFrame:
    """Per job and batch: pages seen so far, pages expected, and whether the job has ended."""
    return events.groupBy("job").applyInPandasWithState(_job, "job string, pages int, page_count int, ended boolean", "pages int, page_count int, ended boolean", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder, and read it.

    Each batch is written under its number, so a batch that runs again after a failure replaces itself.
    """
    spark = stream.sparkSession
    out, state = work_path(spark, tag), work_path(spark, f"{tag}-state")
    schema = stream.schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], schema)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(out)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return empty
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)


def replay(delivered: DataFrame, job: str) -> DataFrame:
    """A job's pages as delivered, in order of number, each once."""
    return delivered.filter(F.col("job") == job).dropDuplicates(["job", "page"]).orderBy("page")


def finish(delivered: DataFrame, passes: list) -> DataFrame:
    """The passes over whole documents at a job's end, in their order."""
    for p in passes:
        delivered = p(delivered)
    return delivered
