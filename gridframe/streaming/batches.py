"""Sample streams sealed into batches: reordering by sequence number, then a count window that holds back the ragged tail.

Several streams run beside each other; one stream is one key, since its batches follow its numbers one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that stateful processors need, as a session setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SEALED = "stream_id string, batch_id bigint, sample_idx bigint, sample_seq bigint, payload string"


class CountWindow(StatefulProcessor):
    """State of a stream: the next number to give out, and samples that came early or wait for their batch to fill."""

    def __init__(self, batch: int):
        self.batch = batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begin = self.next.get()[0] if self.next.exists() else 0
        for frame in rows:
            for seq, payload in zip(frame["sample_seq"], frame["payload"], strict=True):
                if int(seq) >= begin:  # a number given out before is a repeat
                    self.waiting.updateValue((int(seq),), (payload,))
        while all(self.waiting.containsKey((begin + k,)) for k in range(self.batch)):
            seqs = range(begin, begin + self.batch)
            payloads = [self.waiting.getValue((s,))[0] for s in seqs]
            for s in seqs:
                self.waiting.removeKey((s,))
            yield pd.DataFrame({"stream_id": key[0], "batch_id": begin // self.batch, "sample_idx": range(self.batch), "sample_seq": seqs, "payload": payloads})
            begin += self.batch
        self.next.update((begin,))

    def close(self) -> None:
        pass


def seal_stream(samples: DataFrame, batch: int) -> DataFrame:
    """Rows of ``SEALED`` for a stream of (stream_id, sample_seq, payload), numbers from 0 in any order.

    A batch comes out once all its samples and all before them are there; each sample once, in order.
    """
    rows = samples.select("stream_id", "sample_seq", "payload")
    return rows.groupBy("stream_id").transformWithStateInPandas(CountWindow(batch), SEALED, "Append", "None")
