"""Ingestion jobs as an at-least-once stream, with retries, dead letters, progress, rate limits, breakers and expiring memory.

Micro-batches are applied by idempotent keyed writes, so a batch that is delivered again changes nothing. State that depends on what
came before a key is applyInPandasWithState: the stage machine and the memory forget idle keys after a timeout, the breaker keeps a few numbers for each
provider.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.settings import STAGES, Queue

MESSAGE = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("organization_id", T.LongType()), T.StructField("document_id", T.LongType()), T.StructField("attempt", T.IntegerType()), T.StructField("fail", T.BooleanType()), T.StructField("terminal", T.BooleanType())])


def messages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON messages; malformed lines and those without a job are dropped."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(path)
    return raw.select(F.from_json("value", MESSAGE).alias("m")).select("m.*").where("job_id is not null")


def settle(batch: DataFrame, attempts: DataFrame | None, q: Queue = Queue()) -> DataFrame:
    """A delivered batch with each job's outcome: done, retry, or dead (terminal failure or attempts used up).

    A job delivered more than once in a batch counts each delivery as an attempt."""
    per = batch.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), F.max("organization_id").alias("organization_id"), F.max("document_id").alias("document_id"), F.bool_and("fail").alias("fail"), F.bool_or("terminal").alias("terminal"))
    if attempts is not None:
        per = per.join(attempts.select("job_id", F.col("attempts").alias("_before"), F.col("outcome").alias("_was")), "job_id", "left")
    else:
        per = per.withColumns({"_before": F.lit(0), "_was": F.lit(None).cast("string")})
    n = (F.coalesce("_before", F.lit(0)) + F.col("_n")).cast("long")
    over = F.col("_was").isin("done", "dead")
    outcome = F.when(over, F.col("_was")).when(~F.col("fail"), "done").when(F.col("terminal") | (n >= q.max_attempts), "dead").otherwise("retry")
    return per.select("job_id", "organization_id", "document_id", F.when(over, F.col("_before").cast("long")).otherwise(n).alias("attempts"), outcome.alias("outcome"))


def run_jobs(stream: DataFrame, state_path: str, checkpoint: str, work: Callable[[DataFrame], None] | None = None):
    """Starts the query. After each batch the job table at state_path holds every job's attempts and outcome; each batch writes a
    new folder named by its id, so writing it again is harmless."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_jobs(spark, state_path, batch_id - 1)
        got = settle(batch, before)
        if work is not None:
            work(got.where("outcome = 'done'"))
        rest = before.join(got, "job_id", "left_anti").unionByName(got) if before is not None else got
        rest.write.mode("overwrite").parquet(f"{state_path}/{batch_id:08d}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_jobs(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{state_path}/{batch_id:08d}") if batch_id >= 0 else None


def stale(deliveries: DataFrame, q: Queue = Queue()) -> DataFrame:
    """Deliveries that nobody has acknowledged for the visibility time, to be claimed before new ones."""
    return deliveries.where((F.col("acked") == F.lit(False)) & (F.col("idle_ms") >= q.visibility_ms)).orderBy(F.desc("idle_ms"), "job_id")


def queue_stats(deliveries: DataFrame) -> DataFrame:
    return deliveries.agg(F.count(F.lit(1)).alias("depth"), F.count_if(~F.col("acked")).alias("pending"), F.coalesce(F.max(F.when(~F.col("acked"), F.col("idle_ms"))), F.lit(0)).alias("oldest_idle_ms"), F.count_if("dead").alias("dead"))


def progress(events: DataFrame) -> DataFrame:
    """The furthest stage of each job and its share of the way; late or repeated events never take a job back. A job with a FAILED
    event is at FAILED, its way over."""
    done = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    share = F.when(F.col("stage") == "FAILED", 1.0).otherwise(F.try_element_at(done, F.col("stage")))
    last = F.struct((F.col("stage") == "FAILED").alias("f"), share.alias("p"), "stage")
    out = events.where(share.isNotNull()).groupBy("job_id").agg(F.max(last).alias("_s"), F.count(F.lit(1)).alias("n_events"))
    return out.select("job_id", F.col("_s.stage").alias("stage"), F.col("_s.p").alias("progress"), "n_events")


def stage_machine(events: DataFrame, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream of job events (job_id, seq, kind, stage) with each job's attempts, stage, progress and status after every batch.

    A start counts an attempt and begins the way anew; a stage that lies behind the job's own is late and changes nothing; nothing but a start
    takes a job out of COMPLETED or FAILED. Jobs idle for idle_ms are forgotten. The state is three values a job."""
    rank = {s: i for i, s in enumerate(STAGES)}

    def fold(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        attempts, stage, status = state.get if state.exists else (0, "", "QUEUED")
        seen = sorted({(int(r.seq), r.kind, r.stage if isinstance(r.stage, str) else "") for f in frames for r in f.itertuples()})
        for _, kind, to in seen:
            if kind == "start":
                attempts, stage, status = attempts + 1, to, "RUNNING"
            elif status == "RUNNING" and kind == "stage" and rank.get(to, -1) > rank.get(stage, -1):
                stage = to
            elif status == "RUNNING" and kind in ("complete", "fail"):
                status = "COMPLETED" if kind == "complete" else "FAILED"
                stage = "COMPLETED" if kind == "complete" else stage
        state.update((attempts, stage, status))
        state.setTimeoutDuration(idle_ms)
        done = 1.0 if status == "FAILED" else STAGES.get(stage, 0.0)
        yield pd.DataFrame({"job_id": [key[0]], "attempts": [attempts], "stage": [stage or None], "progress": [done], "status": [status]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, attempts long, stage string, progress double, status string", "attempts long, stage string, status string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def rate_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests a minute by user over a stream with event time ts; the watermark bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count(F.lit(1)).alias("n_requests")).select(F.col("window.start").alias("minute"), "user_id", "n_requests")


def breaker(calls: DataFrame, threshold: int = 5, window_s: float = 30.0, open_s: float = 20.0) -> DataFrame:
    """A stream of calls (provider, at double, ok) with whether each was let through, and the breaker's state after it.

    Closed: failures of the last window_s add up; at the threshold it opens. Open: nothing passes for open_s. Then one probe: a success
    closes it, a failure opens it again."""

    def fold(key, frames, state: GroupState):
        fails, opened = state.get if state.exists else ([], None)
        fails = list(fails)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for r in rows.itertuples():
            probe = opened is not None and r.at - opened >= open_s
            passed = opened is None or probe
            if passed and r.ok:
                fails, opened = [] if probe else fails, None
            elif passed:
                fails = [t for t in fails if r.at - t <= window_s] + [r.at]
                if probe or len(fails) >= threshold:
                    opened = r.at
            out.append((key[0], r.at, bool(passed), "OPEN" if opened is not None else "CLOSED"))
        state.update((fails, opened))
        yield pd.DataFrame(out, columns=["provider", "at", "passed", "state"])

    return calls.groupBy("provider").applyInPandasWithState(fold, "provider string, at double, passed boolean, state string", "fails array<double>, opened double", "append", GroupStateTimeout.NoTimeout)


def memory(turns: DataFrame, keep: int = 20, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream of (conv_id, turn, text) with the last turns of each conversation after each batch; idle conversations are forgotten."""

    def fold(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += list(zip(f["turn"].tolist(), f["text"].tolist(), strict=True))
        held = sorted(set(held))[-2 * keep :]
        state.update(([t for t, _ in held], [x for _, x in held]))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(held)], "last_turn": [held[-1][0]]})

    return turns.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, n_turns long, last_turn long", "turns array<long>, texts array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def requeue(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed and cancelled jobs of the list go back to the queue with no attempts; others stay."""
    hit = ids.select("job_id").distinct().withColumn("_ask", F.lit(True))
    again = F.coalesce("_ask", F.lit(False)) & F.col("status").isin("FAILED", "CANCELLED")
    return jobs.join(hit, "job_id", "left").withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(again, "QUEUED").otherwise(F.col("status"))).drop("_ask")


def requeue_versions(versions: DataFrame, again: DataFrame) -> DataFrame:
    """FAILED versions of the jobs that go back to the queue (document_id, version_number) are PROCESSING again; others stay."""
    hit = again.select("document_id", "version_number").distinct().withColumn("_ask", F.lit(True))
    back = F.coalesce("_ask", F.lit(False)) & (F.col("status") == "FAILED")
    return versions.join(hit, ["document_id", "version_number"], "left").withColumn("status", F.when(back, "PROCESSING").otherwise(F.col("status"))).drop("_ask")


def ordered_frames(events: DataFrame) -> DataFrame:
    """Server-sent event frames in order within a job."""
    n = F.row_number().over(W.partitionBy("job_id").orderBy("seq"))
    return events.withColumn("frame", F.format_string("id: %s\nevent: %s\ndata: %s\n\n", n.cast("string"), F.col("kind"), F.to_json(F.struct("job_id", "seq", "payload"))))
