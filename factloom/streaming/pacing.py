"""Token admission as a stream: a key's window is state, so a restarted query goes on where it stood."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pacing import ADMISSION, TokenWindow
from ..shipping import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """A key's requests of a batch in order of time and ``order``; state is what the last 60 seconds hold, and the last admission."""

    def __init__(self, target: int, at: str, order: str, asked: str) -> None:
        self.target, self.at, self.order, self.asked = target, at, order, asked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "last long, times array<long>, tokens array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.window.get() if self.window.exists() else (None, [], [])
        window = TokenWindow(self.target, had[0], list(zip(had[1], had[2], strict=True)))
        frame = pd.concat(list(rows), ignore_index=True).sort_values([self.at, self.order], ignore_index=True)
        found = [window.ask(int(a), int(n), int(n)) for a, n in zip(frame[self.at], frame[self.asked], strict=True)]
        self.window.update((window.last, [t for t, _ in window.events], [n for _, n in window.events]))
        for i, name in enumerate(("admitted_at", "wait", "used")):
            frame[name] = pd.array([f[i] for f in found], dtype="Int64")
        yield frame

    def close(self) -> None:
        pass


def admitted(stream: DataFrame, key: str, at: str, order: str, target: int, folder: str, asked: str = "tokens", files: str = "out") -> DataFrame:
    """Runs over what is there, or what came since the query of this ``folder`` ended, and gives all rows admitted so far.

    Batches have to come in order of time: a request that comes after later ones waits behind them.
    """
    spark = stream.sparkSession
    ship(spark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    schema = f"{fields}, {ADMISSION}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        out = stream.filter(f"{at} is not null").groupBy(key).transformWithStateInPandas(Admission(target, at, order, asked), schema, "Append", "None")
        query = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/{files}").start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(schema).parquet(f"{folder}/{files}")
