"""What changes from one time step to the next: rows that appear, move or vanish.

``changes`` compares steps that are all there.  ``arriving`` does so while they arrive: the
last step and values of each key are the state between micro-batches, and the state of a key
expires when the next step has passed without it, which is when it is told as vanished.

Defined cases: a key of a step that the step before lacks has appeared (all keys of the
first step have); one with other values has moved; one that the next step lacks has vanished
in that step, unless the step is the last; of a key's repeated rows in one step the first in
order of values counts; null values are values; rows of a null key or step take no part;
rows of a step that their key has passed already are left out of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

APPEARED, MOVED, VANISHED = "appeared", "moved", "vanished"


def changes(df: DataFrame, key: str = "id", step: str = "_step", values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(key, step, change) of a table of steps, numbered without gaps."""
    told = F.struct(*[F.col(f"`{v}`") for v in values])
    rows = df.where(F.col(key).isNotNull() & F.col(step).isNotNull()).select(F.col(key), F.col(step).cast("long").alias("_at"), told.alias("_told"))
    rows = rows.groupBy(key, "_at").agg(F.min("_told").alias("_told"))
    last = rows.agg(F.max("_at").alias("_end"))
    own = Window.partitionBy(key).orderBy("_at")
    rows = rows.withColumns({"_before": F.lag("_at").over(own), "_was": F.lag("_told").over(own), "_next": F.lead("_at").over(own)})
    follows = F.coalesce(F.col("_before") == F.col("_at") - 1, F.lit(False))
    here = F.when(~follows, F.struct("_at", F.lit(APPEARED).alias("change"))).when(~F.col("_was").eqNullSafe(F.col("_told")), F.struct("_at", F.lit(MOVED).alias("change")))
    gone = F.when(F.coalesce(F.col("_next") != F.col("_at") + 1, F.lit(True)), F.struct((F.col("_at") + 1).alias("_at"), F.lit(VANISHED).alias("change")))
    found = rows.select(key, F.explode(F.array(here, gone)).alias("_c")).where("_c IS NOT NULL")
    return found.join(F.broadcast(last), F.col("_c._at") <= F.col("_end")).select(key, F.col("_c._at").alias(step), F.col("_c.change").alias("change"))


def arriving(stream: DataFrame, key: str = "id", step: str = "_step", values: tuple[str, ...] = ("x", "y", "z"), late: str = "0 seconds") -> DataFrame:
    """(key, step, change) of a stream of steps; a step (from 0) stands for a second of event time, ``late`` for how long it is waited for."""
    fields = {f.name: f for f in stream.schema.fields}
    rows = stream.where(F.col(key).isNotNull() & F.col(step).isNotNull()).withColumn("_time", F.timestamp_seconds(F.col(step) + 1)).withWatermark("_time", late)
    out = T.StructType([T.StructField(key, fields[key].dataType), T.StructField(step, T.LongType()), T.StructField("change", T.StringType())])
    state_schema = T.StructType([T.StructField("at", T.LongType()), *[T.StructField(f"v{i}", fields[v].dataType) for i, v in enumerate(values)]])

    def plain(v):
        return None if v is None or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v

    def run(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        found = []
        if state.hasTimedOut:
            found.append((state.get[0] + 1, VANISHED))
            state.remove()
        else:
            table = pd.concat(list(batches))
            rows: dict[int, tuple] = {}
            for at, *told in table[[step, *values]].itertuples(index=False, name=None):
                told, at = tuple(plain(v) for v in told), int(at)
                order = lambda t: [(v is not None, v) for v in t]
                if at not in rows or order(told) < order(rows[at]):
                    rows[at] = told
            last, was = (state.get[0], tuple(state.get[1:])) if state.exists else (None, None)
            for at in sorted(rows):
                if last is not None and at <= last:
                    continue
                if last is not None and at > last + 1:
                    found.append((last + 1, VANISHED))
                if last is None or at > last + 1:
                    found.append((at, APPEARED))
                elif rows[at] != was:
                    found.append((at, MOVED))
                last, was = at, rows[at]
            state.update((last, *was))
            # the next step has come without the key once the watermark is past its beginning
            state.setTimeoutTimestamp(max((last + 2) * 1000 - 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(found), step: [f[0] for f in found], "change": [f[1] for f in found]})

    return rows.groupBy(key).applyInPandasWithState(run, out, state_schema, "append", "EventTimeTimeout")
