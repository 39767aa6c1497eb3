"""Change streams: a log of change events, read by Structured Streaming.

A commit appends its events to the log; a stream over the log passes them on through
stateless pipeline stages.  Payloads are JSON text, since their shape differs by event.
"""

from __future__ import annotations

import json
import queue
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import CompileError, DocError
from ..operators.pipeline import Scope, run_pipeline, validate
from ..sources.documents import as_json, decode, local_folder

_NS = T.StructType([T.StructField("db", T.StringType()), T.StructField("coll", T.StringType())])
SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StructType([T.StructField("_data", T.StringType())])),
        T.StructField("operationType", T.StringType()),
        T.StructField("wallTime", T.TimestampType()),
        T.StructField("ns", _NS),
        T.StructField("to", _NS),
        T.StructField("documentKey", T.StringType()),
        T.StructField("fullDocument", T.StringType()),
        T.StructField("fullDocumentBeforeChange", T.StringType()),
        T.StructField(
            "updateDescription",
            T.StructType(
                [
                    T.StructField("updatedFields", T.StringType()),
                    T.StructField("removedFields", T.ArrayType(T.StringType())),
                    T.StructField("truncatedArrays", T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("newSize", T.IntegerType())]))),
                ]
            ),
        ),
        T.StructField("invalidateReason", T.StringType()),
    ]
)
ALLOWED = frozenset({"$match", "$project", "$addFields", "$set", "$unset"})
OPTIONS = frozenset({"fullDocument", "fullDocumentBeforeChange"})
PAYLOADS = ("documentKey", "fullDocument", "fullDocumentBeforeChange")


def difference(old: dict, new: dict) -> dict[str, Any]:
    """What changed between two versions of a document, by dotted path."""
    updated, removed, cut = {}, [], []

    def walk(a: dict, b: dict, prefix: str) -> None:
        for k in a:
            if k not in b:
                removed.append(prefix + k)
        for k, v in b.items():
            if k not in a:
                updated[prefix + k] = v
            elif a[k] != v or type(a[k]) is not type(v):
                old_v = a[k]
                if isinstance(old_v, dict) and isinstance(v, dict):
                    walk(old_v, v, f"{prefix}{k}.")
                elif isinstance(old_v, list) and isinstance(v, list):
                    if len(v) < len(old_v) and old_v[: len(v)] == v:
                        cut.append({"field": prefix + k, "newSize": len(v)})
                    elif len(v) >= len(old_v) and v[: len(old_v)] == old_v:
                        updated.update({f"{prefix}{k}.{i}": v[i] for i in range(len(old_v), len(v))})
                    else:
                        updated[prefix + k] = v
                else:
                    updated[prefix + k] = v

    walk(old, new, "")
    return {"updatedFields": as_json(updated), "removedFields": removed, "truncatedArrays": cut}


def _without_nulls(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _without_nulls(x) for k, x in v.items() if x is not None}
    return [_without_nulls(x) for x in v] if isinstance(v, list) else v


class ChangeLog:
    """Events of a database, appended to a folder in one write per commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.count = spark, path, 0

    def append(self, events: list[dict]) -> None:
        if not events:
            return
        rows = []
        for e in events:
            self.count += 1
            row = {f.name: e.get(f.name) for f in SCHEMA.fields}
            row["_id"] = {"_data": f"{self.count:016x}"}
            for k in PAYLOADS:
                row[k] = None if row[k] is None else as_json(row[k])
            rows.append(row)
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def append_frame(self, event: dict, after: DataFrame | None, before: DataFrame | None) -> None:
        """One event like ``event`` for each row of a frame, written by the executors, in the order of its partitions."""
        self.count += 1
        head, side = f"{self.count:016x}", "fullDocument" if after is not None else "fullDocumentBeforeChange"
        docs = after if after is not None else before
        same = {f.name: event.get(f.name) for f in SCHEMA.fields}
        same["wallTime"] = event["wallTime"].astimezone()

        def run(batches):
            from pyspark import TaskContext

            task, n = TaskContext.get().partitionId(), 0
            for batch in batches:
                rows = []
                for d in batch.to_pylist():
                    d = _without_nulls(d)
                    rows.append({**same, "_id": {"_data": f"{head}-{task:08x}-{n:010x}"}, "documentKey": as_json({"_id": d.get("_id")}), side: as_json(d)})
                    n += 1
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

        kind = to_arrow_schema(SCHEMA)
        docs.mapInArrow(run, SCHEMA).write.mode("append").json(self.path)

    def stream(self) -> DataFrame:
        self.spark.createDataFrame([], SCHEMA).write.mode("append").json(self.path)
        return self.spark.readStream.schema(SCHEMA).json(self.path)


def checked(pipeline: list[dict] | None, options: dict) -> list[dict]:
    pipeline = pipeline or []
    validate(pipeline)
    for stage in pipeline:
        if odd := set(stage) - ALLOWED:
            raise CompileError(f"{odd.pop()} is not allowed in a change stream")
    for refused in ("resumeAfter", "startAfter", "startAtOperationTime"):
        if refused in options:
            raise CompileError(f"{refused} is not supported; a streaming checkpoint resumes a stream")
    if odd := set(options) - OPTIONS:
        raise CompileError(f"unknown option {', '.join(sorted(odd))}")
    return pipeline


class ChangeStream:
    """Events of a namespace since it was opened, as an iterator or a streaming DataFrame."""

    def __init__(self, log: ChangeLog, where: dict, pipeline: list[dict] | None = None, **options: Any):
        self.pipeline, self.options, self.log, self.where = checked(pipeline, options), options, log, where
        self.since, self.closed, self._ready, self._query = log.count, False, queue.Queue(), None
        log.watchers = getattr(log, "watchers", 0) + 1

    def frame(self) -> DataFrame:
        """The stream after its pipeline, for ``writeStream``."""
        events = self.log.stream().where(f"_id._data > '{self.since:016x}'")
        for k, v in self.where.items():
            events = events.where(f"ns.{k} = '{v}' or operationType in ('invalidate', 'dropDatabase')")
        if not self.options.get("fullDocumentBeforeChange"):
            events = events.drop("fullDocumentBeforeChange")
        return run_pipeline(events, self.pipeline, Scope())

    def read(self) -> DataFrame:
        """All events that are in the log by now, as a frame: a stream's batches, stored by the executors."""
        shared = self.log.spark.sparkContext.getConf().get("spark.checkpoint.dir") or local_folder(self.log.spark)
        place = f"{shared}/changes-{uuid.uuid4().hex}"
        frame = self.frame()
        stream = frame.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state")
        stream.trigger(availableNow=True).start().awaitTermination()
        return self.log.spark.read.schema(frame.schema).parquet(f"{place}/rows")

    def _pull(self) -> None:
        """All events that are in the log by now."""
        if self._query is None:
            context = self.log.spark.sparkContext
            base = context.getConf().get("spark.checkpoint.dir")
            self._state = f"{base}/changes-{uuid.uuid4().hex}" if base else local_folder(self.log.spark)
            self._query = True

        def collect(batch: DataFrame, _: int) -> None:
            order = ["_id._data"] if "_id" in batch.columns else []
            for row in (batch.orderBy(*order) if order else batch).collect():
                event = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
                for k in PAYLOADS:
                    if isinstance(event.get(k), str):
                        event[k] = decode(json.loads(event[k]))
                if isinstance(event.get("updateDescription"), dict):
                    event["updateDescription"]["updatedFields"] = decode(json.loads(event["updateDescription"]["updatedFields"] or "{}"))
                self._ready.put(event)

        stream = self.frame().writeStream.foreachBatch(collect).option("checkpointLocation", self._state)
        stream.trigger(availableNow=True).start().awaitTermination()

    def try_next(self) -> dict | None:
        if self.closed:
            raise DocError("the change stream is closed")
        if self._ready.empty():
            self._pull()
        if self._ready.empty():
            return None
        event = self._ready.get()
        if event.get("operationType") == "invalidate":
            self.close()
        return event

    def has_next(self) -> bool:
        if self.closed:
            return False
        if self._ready.empty():
            self._pull()
        return not self._ready.empty()

    def __iter__(self) -> Iterator[dict]:
        while not self.closed and self.has_next():
            yield self.try_next()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.log.watchers -= 1
