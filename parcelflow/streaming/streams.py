"""The incremental parts as Structured Streaming jobs, with the results of their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parcelflow.functions.text import page_alive
from parcelflow.operators.joins import next_ids
from parcelflow.plans import billing
from parcelflow.plans.links import link_duplicates
from parcelflow.plans.load import KEYS, RUNS, STATE, counted, load_snapshot, widened
from parcelflow.sources.files import kept, temporary
from parcelflow.sources.state import StateStore


def apply_snapshot(store: StateStore, snapshot: DataFrame, as_of: str, tag: str) -> None:
    """One snapshot on the stored state, as the store's next version; events, links and the run are appended to the logs.

    Only the snapshot's sources are read, from buckets that need no shuffle, and only their files are replaced; the next state is
    written bucket by bucket, as it is joined.
    """
    last = store.read("runs", RUNS).orderBy(F.desc("run_id")).select("run_id", "last_property", "last_event").first() or (0, 0, 0)
    counts = counted(widened(snapshot))
    sources = sorted(x for x in counts if x is not None)
    m = store.manifest()
    with temporary(store.spark):
        done = load_snapshot(snapshot, store.bucketed("state", STATE, KEYS, sources), as_of, last[0] + 1, last[1], last[2], counts, by=store.dealt_by(m, "state", KEYS), buckets=m["buckets"])
        store.commit(tag, append={"events": done.events, "links": done.links, "runs": done.run}, keyed={"state": (done.state, KEYS, sources)}, dealt=["state"])


def relink(store: StateStore, tag: str) -> None:
    """The duplicate links of all stored properties, made anew and replaced as the store's next version."""
    with temporary(store.spark):
        store.commit(tag, replace={"duplicates": link_duplicates(store.read("state", STATE))})


def snapshot_stream(spark: SparkSession, snapshots: DataFrame, store: StateStore, as_of_col: str, checkpoint: str):
    """Each arriving snapshot applied once, in order of its time: a batch may hold several. Starts the query.

    A snapshot's tag is its batch and time, so a batch that is run again goes on after the snapshots that it has committed.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        times = sorted(r[0] for r in batch.select(F.col(as_of_col).cast("string")).distinct().collect() if r[0] is not None)  # a value a snapshot
        for time in times:
            tag = f"{batch_id}:{time}"
            if not store.applied(tag):
                apply_snapshot(store, batch.where(F.col(as_of_col).cast("string") == time).drop(as_of_col), time, tag)

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def webhook_dedup(events: DataFrame, time: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """Redelivered events once, as long as they come within the delay; webhook_stream() stops later ones too."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])


#: The log of events that have been applied, in folders by day.
WEBHOOKS = "event_id long, seq long, day date"


def unseen(batch: DataFrame, store: StateStore, days: int) -> DataFrame:
    """The events of a batch that are not in the log, each once; with the day of their time.

    A redelivery's time is within some days of the first delivery's, so only the log's folders of those days are read.
    """
    rows = billing.once(batch.where(F.col("event_id").isNotNull())).withColumn("day", F.to_date("event_time"))
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    log = store.read("webhooks", WEBHOOKS)
    near = log.where(F.col("day").isNull() if first is None else F.col("day").between(F.date_sub(F.lit(first), days), F.date_add(F.lit(last), days)) | F.col("day").isNull())
    return rows.join(near.select("event_id"), "event_id", "left_anti")


def webhook_stream(events: DataFrame, store: StateStore, checkpoint: str, days: int = 3, fold: bool = False):
    """Events (event_id, seq, event_time, ...) applied once, however late they come again within some days. Starts the query.

    The log of event ids and, if asked for, the subscriptions that the events change are committed as one version, so a batch
    that fails is applied again in whole. Events without an id are left out. Only the buckets of subscriptions that a
    batch touches are read and replaced.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if store.applied(str(batch_id)):
            return
        with temporary(store.spark):
            fresh = kept(unseen(batch, store, days), "fresh")
            keyed = {}
            if fold:
                new = kept(billing.folded(fresh), "folded")
                parts = [r[0] for r in new.select("bucket").distinct().collect()]  # at most billing.BUCKETS
                old = store.bucketed("subscriptions", billing.SUBSCRIPTIONS, billing.SUBSCRIPTION_KEYS, parts)
                keyed["subscriptions"] = (billing.merged(old.unionByName(new)), billing.SUBSCRIPTION_KEYS, parts)
            store.commit(str(batch_id), append={"webhooks": (fresh.select("event_id", "seq", "day"), "day")}, keyed=keyed)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscription_stream(events: DataFrame, store: StateStore, checkpoint: str, days: int = 3):
    """webhook_stream() with the subscriptions' state: a checkout gives its email, a deletion ends it."""
    return webhook_stream(events, store, checkpoint, days, fold=True)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate(StatefulProcessor):
    """Lets a row of a key through if it comes some time or more after the last one let through.

    The state is that row's time. Once the watermark has passed the end of its interval every row to come is let through
    anyway, so a timer set for that end frees the state.
    """

    def __init__(self, key: str, time: str, micros: int, wanted: str | None = None):
        self.key, self.time, self.micros, self.wanted = key, time, micros, wanted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        last, out = before, []
        batch = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        for t, wanted in zip(batch[self.time], batch[self.wanted] if self.wanted else [True] * len(batch), strict=True):
            at = t.value // 1000
            if last is None or at >= last + self.micros:
                last = at
                if wanted:
                    out.append((key[0], t))
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.micros // 1000)
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.micros // 1000)
        yield pd.DataFrame(out, columns=[self.key, self.time])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame(columns=[self.key, self.time])

    def close(self) -> None:
        pass


def gated(rows: DataFrame, key: str, time: str, micros: int, wanted: str | None, delay: str) -> DataFrame:
    """(key, time) of the wanted rows that Gate lets through; rows over delay late are left out."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what timers need
    kind = rows.schema[key].dataType.simpleString()
    own = rows.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(key)
    return own.transformWithStateInPandas(Gate(key, time, micros, wanted), f"`{key}` {kind}, `{time}` timestamp", "Append", "EventTime")


def link_checks(results: DataFrame, minutes: int = 15, delay: str = "1 hour") -> DataFrame:
    """Dead listings (property_id, checked_at), at most one check of a property in some minutes.

    results: property_id long, checked_at timestamp, http_status int, html string. The state holds a property's last check
    until the watermark is past it by those minutes.
    """
    seen = results.select("property_id", "checked_at", (~page_alive(F.col("http_status"), F.col("html"))).alias("dead"))
    return gated(seen, "property_id", "checked_at", minutes * 60_000_000, "dead", delay)


def disappeared_events(dead: DataFrame, state: DataFrame, next_event: int, run_id: int) -> DataFrame:
    """Disappeared events of dead listings (property_id, checked_at) whose last event is not one already, the first check of each."""
    first = dead.groupBy("property_id").agg(F.min("checked_at").alias("checked_at"))
    rows = state.where(~F.col("last_event").eqNullSafe(F.lit("disappeared"))).join(first, "property_id")
    numbered = next_ids(rows.select("property_id", "auction_id", "status", "checked_at"), "property_id", next_event, "event_id")
    return numbered.select("event_id", "auction_id", F.lit("disappeared").alias("event_type"), F.col("status").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.col("checked_at").cast("timestamp_ntz").alias("detected_at"), F.lit(run_id).cast("long").alias("run_id"))


def cooldown(sends: DataFrame, hours: int = 4, delay: str = "1 hour") -> DataFrame:
    """Sends (email, sent_at timestamp) that come some hours or more after the last one let through to the address."""
    return gated(sends.select("email", "sent_at"), "email", "sent_at", hours * 3_600_000_000, None, delay)
