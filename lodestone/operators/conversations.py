"""Grouping of messages: by conversation, by gaps in time, the last of each channel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concatenated(messages: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", sep: str = "\n") -> DataFrame:
    """``(by, n_messages, text)``: ``role: text`` lines in order."""
    line = F.concat(F.col(role), F.lit(": "), F.col(text))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return messages.groupBy(by).agg(F.count("*").alias("n_messages"), F.array_join(F.transform(rows, lambda x: x["l"]), sep).alias("text"))


def participants(messages: DataFrame, by: str, who: str, when: str) -> DataFrame:
    """``(by, first_at, last_at, n_participants, n_messages)``."""
    return messages.groupBy(by).agg(F.min(when).alias("first_at"), F.max(when).alias("last_at"), F.countDistinct(who).alias("n_participants"), F.count("*").alias("n_messages"))


def last_n(messages: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """The last n messages of each channel."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return messages.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def gap_groups(messages: DataFrame, by: str, when: str, minutes: int = 30, tie: str | None = None) -> DataFrame:
    """Adds ``group_no``: a new group begins after each pause of more than so many minutes."""
    order = [F.col(when), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(by).orderBy(*order)
    pause = F.unix_micros(F.col(when).cast("timestamp")) - F.unix_micros(F.lag(F.col(when).cast("timestamp")).over(w)) > minutes * 60_000_000
    return messages.withColumn("__new", F.when(pause, 1).otherwise(0)).withColumn("group_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


_GROUPS = "group_no long, first_at timestamp, last_at timestamp, n_messages long, text string"


def budget_groups(messages: DataFrame, by: str, when: str, length: int, minutes: int = 30, tie: str = "event_id", text: str = "text", overlap: int = 0) -> DataFrame:
    """``(by, group_no, first_at, last_at, n_messages, text)``: a group also ends before its texts pass ``length`` characters.

    A group begins with the last ``overlap`` messages of the one before, unless a pause lies between. The messages are sorted within partitions and read as a stream, so that nobody's
    messages need to fit into memory; nulls count as empty texts.
    """
    key = messages.schema[by].dataType.simpleString()
    rows = messages.select(F.col(by).alias("k"), F.unix_micros(F.col(when).cast("timestamp")).alias("t"), F.col(tie).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("x"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        who, no, size, fresh, out = None, 0, 0, 0, []

        def close() -> None:
            out.append((who, no, held[0][0], held[-1][0], len(held), "\n".join(x for _, x in held)))

        def batch() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["k", "group_no", "first_at", "last_at", "n_messages", "text"])

        kind = None
        for part in parts:
            kind = part.schema.field("k").type
            for k, t, x in zip(*(part.column(c).to_pylist() for c in ("k", "t", "x"))):
                if fresh and k != who:
                    close()
                    held, no, size, fresh = [], 0, 0, 0
                elif fresh and (t - held[-1][0] > minutes * 60_000_000 or size + len(x) > length):
                    close()
                    held = held[-overlap:] if overlap and t - held[-1][0] <= minutes * 60_000_000 else []
                    no, size, fresh = no + 1, sum(len(y) for _, y in held), 0
                who = k
                held.append((t, x))
                size, fresh = size + len(x), fresh + 1
            if len(out) > 1000:
                yield batch()
                out.clear()
        if fresh:
            close()
        if out:
            yield batch()

    ordered = rows.repartition("k").sortWithinPartitions("k", "t", "i").select("k", "t", "x")
    return ordered.mapInArrow(cut, f"k {key}, {_GROUPS}").withColumnRenamed("k", by)
