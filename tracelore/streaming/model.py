"""Models over streams: rows are appended as they come, and frequencies forget what leaves the window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def learning(stream: DataFrame, learn: Callable[[DataFrame], None], checkpoint: str):
    """Hand each micro-batch to a learner in arrival order; what is available now, then stop."""
    return stream.writeStream.foreachBatch(lambda batch, _: learn(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appending(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet, each file once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def sliding_frequency(features: DataFrame, *, width: int = 1000) -> DataFrame:
    """(seq, feature, df): in how many of the `width` instances before its own a feature stands, kept as state by feature.

    features: a stream of (seq, feature), seq dense and rising from batch to batch. The state of a feature is its last numbers, at
    most `width` of them; numbers that left the window are forgotten with the next row.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            out = []
            for seq in sorted(batch["seq"]):
                held = [s for s in held if s >= seq - width]
                out.append((seq, key[0], sum(s < seq for s in held)))
                held.append(int(seq))
            yield pd.DataFrame(out, columns=["seq", "feature", "df"])
        state.update((held,))

    return features.groupBy("feature").applyInPandasWithState(update, "seq long, feature string, df long", "held array<long>", "append", GroupStateTimeout.NoTimeout)
