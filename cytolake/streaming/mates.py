"""Mates of a stream of records made to fragments: records wait in state by name until a timer fires, then what has come is merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import strip_suffix
from ..operators.reads import mate_fields, merged_groups

_MATE = "rc boolean, pos bigint, flag int, qname string, rnext string, pnext bigint, cigar string, seq string, tags array<string>"
_FIELDS = [f.split()[0] for f in _MATE.split(", ")]
#: Names that leave as one batch.
GROUPS = 10_000
_KINDS = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
#: A record as it waits: with its names, its time and, once it is known, when its name is due.
_HELD = pa.schema([("name", pa.string()), ("rname", pa.string()), ("at", pa.int64()), ("due", pa.int64()), *((f.split()[0], _KINDS[f.split()[1]]) for f in _MATE.split(", "))])


def _stored(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def due_of(parts: list[pa.Table], wait: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """All rows of parts, in the order that they came; of each row its group (a name on a chromosome); and when each group is due: the least time that it has in the first part it is in, plus the wait."""
    rows = pa.concat_tables(parts)
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    codes = [rows[c].combine_chunks().dictionary_encode().indices.to_pandas().fillna(-1).to_numpy(np.int64) for c in ("name", "rname")]
    _, group = np.unique(np.stack(codes, axis=1), axis=0, return_inverse=True)
    group = group.ravel()
    first = np.full(group.max(initial=-1) + 1, len(parts))
    np.minimum.at(first, group, part)
    own = rows["due"].to_pandas().fillna(-1).to_numpy(np.int64)
    asked = np.where(own >= 0, own, rows["at"].to_numpy() + wait)
    due = np.full(len(first), np.iinfo(np.int64).max)
    early = part == first[group]
    np.minimum.at(due, group[early], asked[early])
    return rows, group, due


class HeldMates(StatefulProcessor):
    """The records of the names of one bucket. The first of a name to come makes it due at its time plus the wait; when the watermark passes that, all records of the name that wait leave together.

    What comes in a batch waits as one value, and a bucket has one timer, at the least time that a name may be due.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.next = handle.getValueState("next", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, parts = None, []
        for some in rows:
            if len(some):
                parts.append(pa.Table.from_pandas(some.assign(due=pd.Series([None] * len(some), dtype="Int64"))[_HELD.names], _HELD, preserve_index=False))
                first = min(int(some["at"].min()), first if first is not None else int(some["at"].min()))
        if parts:
            self.held.appendValue((_stored(pa.concat_tables(parts)),))
            self.wake(first + self.wait)
        return iter(())

    def wake(self, at: int) -> None:
        if self.next.exists():
            before = self.next.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.next.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.next.clear()
        rows, group, due = due_of([pa.ipc.open_stream(v[0]).read_all() for v in self.held.get()], self.wait)
        gone = due < max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        self.held.clear()
        stay = ~gone[group]
        if stay.any():
            left = rows.filter(pa.array(stay))
            self.held.appendValue((_stored(left.set_column(_HELD.names.index("due"), "due", pa.array(due[group[stay]]))),))
            self.wake(int(due[~gone].min()))
        leave = np.flatnonzero(gone[group])
        leave = leave[np.argsort(group[leave], kind="stable")]
        begins = np.flatnonzero(np.append(True, np.diff(group[leave]) != 0)[: len(leave)])
        some = rows.take(pa.array(leave))
        records = some.select(_FIELDS).to_pylist()
        for k in range(0, len(begins), GROUPS):
            here, end = begins[k : k + GROUPS].tolist(), [*begins[k + 1 : k + GROUPS + 1].tolist(), len(leave)][: len(begins[k : k + GROUPS])]
            heads = some.select(["name", "rname"]).take(pa.array(here))
            yield pd.DataFrame({"name": heads["name"].to_pylist(), "rname": heads["rname"].to_pylist(), "r": [records[i:j] for i, j in zip(here, end)]})

    def close(self) -> None:
        pass


def streamed_mates(records: DataFrame, time: str = "ts", wait: int = 60_000, late: str = "0 seconds", suffix: int = 1, longest: int = 10000, buckets: int = 512) -> DataFrame:
    """merged_records() of a stream of standardised records with a time: the same columns, in append mode.

    Records of one name wait for `wait` milliseconds of the stream's time after the first of them; what has come by then is merged
    as merged_records() merges it, so the order of arrival makes no difference. A mate that comes later is alone, and single. Records
    behind the watermark, `late` behind the greatest time seen, are dropped by Spark. State is what waits, so it grows
    with the reads of `wait`, not with the stream; names are dealt to `buckets`, each with one value of state for a batch and one timer. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    named = records.withWatermark(time, late).select(strip_suffix(F.col("qname"), suffix).alias("name"), "rname", F.col(time), F.expr(f"unix_millis(`{time}`)").alias("at"), mate_fields().alias("m"))
    flat = named.select("name", "rname", time, "at", "m.*")
    out = f"name string, rname string, r array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _MATE.split(', '))}>>"
    flat = flat.withColumn("bucket", F.pmod(F.xxhash64("name", "rname"), F.lit(buckets)).cast("int"))
    held = flat.groupBy("bucket").transformWithStateInPandas(HeldMates(wait), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return merged_groups(held, longest)
