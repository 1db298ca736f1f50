"""The status machine of jobs as a stream: a keyed state, checked transitions, and results that a repeated batch doesn't double."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Which status an action leads to, and from which (fixed values); a retry is allowed from any status.
TRANSITIONS = {("", "create"): "queued", ("queued", "start"): "processing", ("processing", "finish"): "done", ("processing", "fail"): "failed"}
RETRY = "retry"
STATE = "status string, error string, finished_at timestamp, result string, n_applied long, n_rejected long"
OUTPUT = "job long, status string, error string, finished_at timestamp, result string, n_applied long, n_rejected long, last_seq long"


def applied(state: tuple, action: str, at, detail: str | None) -> tuple:
    """State after one action: status, error, finished_at, result, n_applied, n_rejected. A finish keeps its result, a failure its message; a retry clears error and time but not the result; what isn't allowed changes nothing and is counted."""
    status, error, finished, result, n, rejected = state
    to = "queued" if action == RETRY and status else TRANSITIONS.get((status, action))
    if to is None:
        return status, error, finished, result, n, rejected + 1
    if to == "queued":
        return to, None, None, result, n + 1, rejected
    if to == "done":
        return to, None, at, detail, n + 1, rejected
    if to == "failed":
        return to, detail, at, result, n + 1, rejected
    return to, error, finished, result, n + 1, rejected


class StatusMachine(StatefulProcessor):
    """One job's actions in the order of their numbers; keeps one small row for each job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        actions = pd.concat(list(rows)).sort_values("seq")
        now = tuple(self.state.get()) if self.state.exists() else ("", None, None, None, 0, 0)
        for action, at, detail in zip(actions["action"], actions["at"], actions["detail"], strict=True):
            now = applied(now, action, at.to_pydatetime(), detail)
        self.state.update(now)
        status, error, finished, result, n, rejected = now
        yield pd.DataFrame({"job": [key[0]], "status": [status], "error": [error], "finished_at": pd.Series([finished], dtype="datetime64[ns]"), "result": [result], "n_applied": [n], "n_rejected": [rejected], "last_seq": [int(actions["seq"].iloc[-1])]})

    def close(self) -> None:
        pass


def run(actions: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of actions (job, seq, action, at, detail) that is there now, and write the jobs that each batch touched.

    The checkpoint holds what was read and the jobs' states, so a run goes on where the last one ended. A batch overwrites its own
    folder, so one that is repeated after a failure isn't counted twice.
    """
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    states = actions.select("job", "seq", "action", "at", "detail").groupBy("job").transformWithStateInPandas(StatusMachine(), OUTPUT, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, sink: str) -> DataFrame:
    """The last state of each job."""
    rows = spark.read.parquet(sink)
    last = rows.groupBy("job").agg(F.max_by(F.struct(*rows.columns), "batch").alias("r"))
    return last.select("r.*").drop("batch")


def finished(rows: DataFrame) -> Row:
    """How many jobs are in each status (one row)."""
    return rows.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("queued", "processing", "done", "failed"))).first()
