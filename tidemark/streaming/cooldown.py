"""Cooldowns of platforms that refuse: as state with timers on a stream, and as sessions of a table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

SCHEMA = "platform string, since timestamp, until timestamp"
_EPOCH = datetime(1970, 1, 1)


def intervals(attempts: DataFrame, minutes: int = 30) -> DataFrame:
    """platform, since and until: from a refusal (platform, at, refused) to `minutes` after the last one that came by the cooldown's end."""
    w = F.session_window("at", f"{minutes} minutes")
    return attempts.filter("refused").groupBy("platform", w.alias("w")).agg(F.count("*").alias("n")).select("platform", F.col("w.start").alias("since"), F.col("w.end").alias("until"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for since, until in sorted(spans):
        if out and since <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], until))
        else:
            out.append((since, until))
    return out


class Cooldown(StatefulProcessor):
    """The open cooldowns of a platform, in microseconds. Refusals may come in any order; a cooldown is given out when the watermark has passed its end."""

    def __init__(self, minutes: int):
        self.length = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "since array<long>, until array<long>")

    def _spans(self) -> list[tuple[int, int]]:
        return list(zip(*self.open.get(), strict=True)) if self.open.exists() else []

    def _keep(self, spans: list[tuple[int, int]]) -> None:
        """Remembers open cooldowns, with a timer just behind the first end."""
        if spans:
            self.open.update(([s for s, _ in spans], [u for _, u in spans]))
            self.handle.registerTimer(-(-min(u for _, u in spans) // 1000) + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self._spans()
        for part in rows:
            at = part.loc[part["refused"].fillna(False).astype(bool), "at"].dropna()
            spans = _merged([*spans, *((t, t + self.length) for t in at.astype("datetime64[us]").astype("int64").tolist())])
        self._keep(spans)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, spans = timerValues.getCurrentWatermarkInMs() * 1000, self._spans()
        done = [(since, until) for since, until in spans if -(-until // 1000) * 1000 < now]
        self._keep([x for x in spans if x not in set(done)])
        if done:
            at = lambda us: _EPOCH + timedelta(microseconds=us)
            yield pd.DataFrame({"platform": [key[0]] * len(done), "since": [at(s) for s, _ in done], "until": [at(u) for _, u in done]})

    def close(self) -> None:
        pass


def write_cooldowns(attempts: DataFrame, path: str, checkpoint: str, minutes: int = 30, late: str = "10 minutes") -> DataStreamWriter:
    """Appends to `path` the cooldowns of a stream of attempts (platform, at, refused), each once, when `late` behind the newest attempt is past its end. A null platform is one of its own."""
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = attempts.select("platform", "at", "refused").withWatermark("at", late).groupBy("platform")
    out = rows.transformWithStateInPandas(Cooldown(minutes), SCHEMA, "Append", "EventTime")
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
