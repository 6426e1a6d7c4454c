"""Progress and event streams.

Functions take a streaming (or batch) DataFrame of events and return one; ``drain``
runs a stream over all that is there and returns what it wrote.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_path


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events table as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run until the sources are exhausted; complete mode keeps the last result, the others all rows."""
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is tried again replaces what its first try wrote.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(out if mode == "complete" else f"{out}/batch=-1")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.schema.fieldNames())


def counts_by_window(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Events and their sum by type and tumbling window; later than ``late`` is dropped when appending."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def debounced(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """One row a burst: events of a key closer than ``gap`` end in one refresh, ``gap`` after the last."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return s.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("fire_at"), "n")


def current_updates(events: DataFrame, key: str, gen: str, order: list[str]) -> DataFrame:
    """Updates of the newest generation seen so far for their key; those of cancelled generations are dropped.

    The state of a key is one number, the newest generation.
    """
    schema = events.schema

    def run(_, batches, state: GroupState):
        newest = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        keep = []
        for g in pdf[gen]:
            newest = g if newest is None or g > newest else newest
            keep.append(g == newest)
        state.update((int(newest),))
        yield pdf[keep]

    return events.groupBy(key).applyInPandasWithState(run, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def last_by_name(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest event of every name, what a late subscriber is told."""
    cols = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("e")).select(*key, "e.*")


def _in_turn(events: DataFrame, key: str, order: list[str], state: str, out: str, step) -> DataFrame:
    """Each key's rows in ``order`` through ``step(state tuple or None, row) -> (state tuple, values or None)``; values make a row of ``out`` after the row itself.

    Rows of a later batch come after those of earlier ones.  The state of a key is one small tuple.
    """
    columns = [f.name for f in events.schema.fields]
    added = [part.split()[0] for part in out.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields] + [out])

    def run(_, batches, held: GroupState):
        now = held.get if held.exists else None
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows = []
        for row in pdf.itertuples(index=False):
            now, made = step(now, row)
            if made is not None:
                rows.append((*row, *made))
        held.update(now)
        yield pd.DataFrame(rows, columns=[*columns, *added])

    return events.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, millis: str, gap_ms: int, order: list[str]) -> DataFrame:
    """The updates of a key that are passed on: the first, and each that comes ``gap_ms`` after the last passed one; ``millis`` is a long column."""
    at = [f.name for f in events.schema.fields].index(millis)

    def step(last, row):
        if last is not None and row[at] < last[0] + gap_ms:
            return last, None
        return (int(row[at]),), (last is None,)

    return _in_turn(events, key, order, "last long", "first boolean", step)


def covering_builds(requests: DataFrame, key: str, x: str, y: str, pad: int, order: list[str]) -> DataFrame:
    """Requests for points against one box a key: a point inside is a hit, another has the box built anew around what it held and the padded point.

    Adds built and the box after the request (west, south, east, north); x, y and ``pad`` are whole numbers.
    """
    names = [f.name for f in requests.schema.fields]
    ix, iy = names.index(x), names.index(y)

    def step(box, row):
        px, py = int(row[ix]), int(row[iy])
        if box is not None and box[0] <= px <= box[2] and box[1] <= py <= box[3]:
            return box, (False, *box)
        new = (px - pad, py - pad, px + pad, py + pad)
        if box is not None:
            new = (min(box[0], new[0]), min(box[1], new[1]), max(box[2], new[2]), max(box[3], new[3]))
        return new, (True, *new)

    return _in_turn(requests, key, order, "w long, s long, e long, n long", "built boolean, west long, south long, east long, north long", step)


def recomputes(sources: DataFrame, key: str, fingerprint: str, order: list[str]) -> DataFrame:
    """Sources that are to be worked out again: adds warm, whether the key's last fingerprint was the same."""
    at = [f.name for f in sources.schema.fields].index(fingerprint)

    def step(last, row):
        return (str(row[at]),), (last is not None and last[0] == str(row[at]),)

    return _in_turn(sources, key, order, "fingerprint string", "warm boolean", step)
