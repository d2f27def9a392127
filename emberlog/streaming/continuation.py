"""Continuation lines on streams: the append policy of structuring, with the open entry of each file held as state.

A line that doesn't fit belongs to the last entry before it in its file, which may have come in an earlier micro-batch, and more
such lines may follow in later ones. So a file's last entry stays open, in the state of a stateful processor, until a line that
fits closes it, until no line of the file has come for a while (a timer), or until the stream is ended and open_entries() reads
what is left. Lines may come in any order: those that come before their turn wait in the state until the gap is filled.

Closed entries and open ones together are the rows of the batch policy, however lines are cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from emberlog.functions.text import strip
from emberlog.operators.structuring import parse
from emberlog.sources.formats import compile_format

#: The provider that keeps more than one state variable.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Continuation(StatefulProcessor):
    """State of a file: the number of the line that is due, and of lines that wait; the open entry (its line's number, fields, and texts that go on); lines
    that came before their turn."""

    def __init__(self, fields: list[str], append_to: str, separator: str, idle_ms: int | None) -> None:
        self._fields, self._append_to, self._separator, self._idle_ms = fields, append_to, separator, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Workers have no session that could read types from text.
        number, texts = StructType([StructField("line_no", LongType())]), ArrayType(StringType())
        self._handle = handle
        self._due = handle.getValueState("due", StructType([*number.fields, StructField("waiting", LongType())]))
        self._open = handle.getValueState("open", StructType([*number.fields, StructField("fields", texts), StructField("texts", texts)]))
        self._waiting = handle.getMapState("waiting", number, StructType([StructField("is_valid", BooleanType()), StructField("text", StringType()), StructField("fields", texts)]))

    def _closed(self, key: tuple, entry: tuple | None) -> list[tuple]:
        if entry is None:
            return []
        line_no, fields, texts = entry
        at = self._fields.index(self._append_to)
        fields = list(fields)
        fields[at] = self._separator.join([fields[at] or "", *texts]) if texts else fields[at]
        return [(key[0], int(line_no), *fields)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is read once and written once for all lines of the file that have come; the lines that wait are asked for only if
        there are any."""
        found, now = [], self._due.get()
        due, waiting = (int(now[0]), int(now[1])) if now is not None else (1, 0)
        entry = self._open.get() if now is not None else None
        if entry is not None:
            entry = (entry[0], list(entry[1]), list(entry[2]))
        before, grown = entry, False

        def take(line_no: int, valid: bool, text: str, fields: list) -> None:
            nonlocal entry, grown
            if valid:
                found.extend(self._closed(key, entry))
                entry = (line_no, fields, [])
            elif entry is not None:
                entry[2].append(text)
                grown = True
            else:
                raise ValueError(f"line {line_no} of {key[0]} doesn't fit the format and no entry is open: {text}")

        came = sorted(((int(r[0]), bool(r[1]), r[2], list(r[3])) for frame in rows for r in zip(frame["line_no"], frame["is_valid"], frame["text"], frame["fields"], strict=True)), key=lambda r: r[0])
        ahead = {}
        for line in came:
            if line[0] < due:
                continue  # the source has sent it again
            if line[0] > due:
                ahead[line[0]] = line[1:]
                continue
            take(*line)
            due += 1
            while due in ahead or waiting and self._waiting.containsKey((due,)):
                if due in ahead:
                    valid, text, fields = ahead.pop(due)
                    if waiting and self._waiting.containsKey((due,)):
                        self._waiting.removeKey((due,))
                        waiting -= 1
                else:
                    valid, text, fields = self._waiting.getValue((due,))
                    self._waiting.removeKey((due,))
                    waiting -= 1
                take(due, bool(valid), text, list(fields))
                due += 1
        for line_no, held in ahead.items():
            waiting += not (waiting and self._waiting.containsKey((line_no,)))
            self._waiting.updateValue((line_no,), held)
        if entry is not None and (entry is not before or grown):
            self._open.update(entry)
        self._due.update((due, waiting))
        if self._idle_ms is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle_ms)
        yield self._frame(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entry = self._closed(key, self._open.get())
        self._open.clear()
        yield self._frame(entry)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "line_no", *self._fields])

    def close(self) -> None:
        pass


def appended_stream(lines: DataFrame, log_format: str, append_to: str, separator: str = "\n", idle_ms: int | None = None, file: str = "file", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """file, line_no (of an entry's first line) and the fields of entries that are closed; lines: a stream of file, line_no (from 1 in
    each file) and line.

    idle_ms: an entry whose file has brought no line for so long is closed too; lines that go on after that fail as they would at
    a file's begin. Without it only a line that fits closes an entry. Needs PROVIDER as the session's state store.
    """
    fmt = compile_format(log_format)
    fields = list(fmt.fields)
    parsed = parse(lines.select(F.col(file).cast("string").alias("file"), F.col(line_no).cast("long").alias("line_no"), F.col(line).alias("line")), fmt)
    slim = parsed.select("file", "line_no", "is_valid", strip(F.col("line")).alias("text"), F.array(*[F.col(f"`{c}`") for c in fields]).alias("fields"))
    schema = StructType.fromDDL("file string, line_no bigint")
    for c in fields:
        schema = schema.add(StructField(c, StringType()))
    processor = _Continuation(fields, append_to, separator, idle_ms)
    return slim.groupBy("file").transformWithStateInPandas(processor, schema, "append", "None" if idle_ms is None else "ProcessingTime")


def open_entries(spark: SparkSession, checkpoint: str, log_format: str, append_to: str, separator: str = "\n") -> DataFrame:
    """The entries that a stopped stream holds open, as appended_stream() would give them; checkpoint: the stream's folder."""
    fields = list(compile_format(log_format).fields)
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint).select(F.col("key.file").alias("file"), F.col("value.*"))
    text = F.concat_ws(separator, F.concat(F.array(F.coalesce(F.col("fields")[fields.index(append_to)], F.lit(""))), F.col("texts")))
    value = lambda i, c: (F.when(F.size("texts") > 0, text).otherwise(F.col("fields")[i]) if c == append_to else F.col("fields")[i]).alias(c)
    return held.filter("line_no IS NOT NULL").select("file", "line_no", *(value(i, c) for i, c in enumerate(fields)))
