"""Order feeds as Structured Streaming: webhook messages, idempotent ingest, daily counters, alerts and notifications.

State is bounded: duplicates are dropped within a watermark, windows close by it, and an order that waits for its validation
is forgotten when its time is up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.clock import Clock
from ..operators import alerts
from ..session import own_folder
from ..sources.bridge import Domain

LATE = "2 days"
#: The fields of a webhook message that are used.
WEBHOOK = "`From` string, `Body` string, `NumMedia` string, `MediaContentType0` string, `MediaUrl0` string, `MessageSid` string"


def feed(spark: SparkSession, path: str, schema: StructType, files_each: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; a checkpoint remembers what was read, so nothing is lost or read twice."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def webhook_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """sender, phone, body, n_media, media_type, kind, subject, content of messages given as JSON lines.

    A line that is no JSON has nulls; a number of media that is none is 0."""
    m = F.from_json(F.col(column), WEBHOOK, {"mode": "PERMISSIVE"})
    x = lines.withColumn("_m", m)
    sender, body = F.coalesce("_m.From", F.lit("N/A")), F.coalesce("_m.Body", F.lit(""))
    n = F.coalesce(F.col("_m.NumMedia").try_cast("int"), F.lit(0))
    none = F.lit(None).cast("string")
    columns = {
        "sender": sender, "phone": F.replace(sender, F.lit("whatsapp:"), F.lit("")), "body": body, "n_media": n, "media_type": F.col("_m.MediaContentType0"),
        "kind": T.media_kind(body, n, F.col("_m.MediaContentType0")), "subject": F.concat(F.lit("WhatsApp - "), sender), "content": T.message_body(body, none, none),
    }
    return x.withColumns(columns).drop("_m")


def with_event_time(stream: DataFrame, column: str, late: str = LATE) -> DataFrame:
    """Event time as a real timestamp (UTC), which watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def deduplicated(stream: DataFrame, key: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, *by: str) -> DataFrame:
    x = stream.groupBy(F.window(time, "1 day").alias("w"), *by).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").cast("date").alias("day"), *by, "n")


def notifications(stream: DataFrame, last_id: int, id_: str = "id") -> DataFrame:
    """Rows after an id, all of them however many arrive at once."""
    return stream.filter(F.col(id_) > last_id)


def batch_alerts(known: Domain, clock: Clock, **thresholds) -> Callable[[DataFrame], DataFrame]:
    """A function of a batch of new orders: the alerts about them, a client's orders counted with those known before."""

    def of(batch: DataFrame) -> DataFrame:
        new = batch.join(known.commandes.select("id"), "id", "left_anti")
        columns = [c for c in known.commandes.columns if c in new.columns]
        both = known.commandes.select(*columns).unionByName(new.select(*columns))
        return alerts.alerts(Domain(known.clients, known.produits, both), clock, **thresholds).join(batch.select(F.col("id").alias("order_id")).distinct(), "order_id", "left_semi")

    return of


def overdue(events: DataFrame, hours: int, key: str = "id", time: str = "at", pending: str = "pending", groups: int = 1024) -> DataFrame:
    """key, since: what has been pending for more than so many hours of event time, once each.

    events (key, time with a watermark, pending): a later event that is not pending takes a key off the list; the watermark
    is the clock. State holds one time a pending key. Keys share `groups` groups of state by their hash, as each group costs
    a call of Python; null keys have their own."""
    wait = int(hours * 3_600_000)

    def each(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = dict(zip(*state.get, strict=True)) if state.exists else {}
        clock = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            x = pd.concat(list(frames)).sort_values("_at", kind="stable")
            names = [None] * len(x) if keys[0] < 0 else x[key].tolist()
            for name, at, waits in zip(names, x["_at"].tolist(), x["_waits"].tolist(), strict=True):
                if waits:
                    waiting.setdefault(name, at)
                else:
                    waiting.pop(name, None)
        due = [name for name, at in waiting.items() if at + wait * 1000 < clock * 1000] if clock else []
        if due:
            yield pd.DataFrame({key: due, "since": [waiting.pop(name) for name in due]})
        if waiting:
            state.update((list(waiting), list(waiting.values())))
            state.setTimeoutTimestamp(max(min(waiting.values()) // 1000 + wait, clock + 1))
        elif state.exists:
            state.remove()

    kind = dict(events.dtypes)[key]
    waits = F.coalesce(F.col(pending), F.lit(False))
    group = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit((1 << 63) - 1))  # an event without a time comes last, and nothing waits from it
    x = events.filter(F.col(time).isNotNull() | ~waits).select(key, time, at.alias("_at"), waits.alias("_waits"), group.alias("_group"))
    found = x.groupBy("_group").applyInPandasWithState(each, f"{key} {kind}, since long", f"names array<{kind}>, since array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, F.timestamp_micros("since").alias("since"))


def every(df: DataFrame, hours: float, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Start a stream that hands its new rows to a function once in so many hours."""
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(hours * 3600)} seconds").foreachBatch(each).start()


def run_available(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there; its rows (or what `each` makes of a batch) as a table in the shared folder.

    A batch is a folder of its own that a retry overwrites, so that each counts once; nothing passes through the driver."""
    spark = df.sparkSession
    root = own_folder(spark, name)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{root}/batch-{number}")
        done.append(number)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    batches = [f"{root}/batch-{n}" for n in sorted(set(done))]
    if not batches:
        return spark.createDataFrame([], df.schema)
    return spark.read.parquet(*(batches[-1:] if mode == "complete" else batches))
