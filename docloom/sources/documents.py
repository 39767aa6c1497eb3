"""Python documents in and out of DataFrames, and versions of collections in storage."""

from __future__ import annotations

import base64
import datetime
import json
import os
import re
import secrets
import tempfile
import threading
import time
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError, DocError
from ..operators.projection import ID, ORDER
from ..plans import values as V
from ..plans.values import NULLS, Value

DEPTH = 200
_COUNTER = secrets.randbelow(1 << 24)
_LOCK = threading.Lock()
_PROCESS = secrets.token_bytes(5)


class ObjectId(str):
    """An identifier: 24 hexadecimal digits, time first."""

    def __new__(cls, value: str | None = None):
        if value is None:
            global _COUNTER
            with _LOCK:
                _COUNTER = (_COUNTER + 1) % (1 << 24)
                value = (int(time.time()).to_bytes(4, "big") + _PROCESS + _COUNTER.to_bytes(3, "big")).hex()
        if not re.fullmatch("[0-9a-fA-F]{24}", value):
            raise DocError(f"'{value}' is not an identifier of 24 hexadecimal digits")
        return super().__new__(cls, value.lower())

    @property
    def generation_time(self) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(int(self[:8], 16), datetime.timezone.utc)


def validate(v: Any, path: str = "", depth: int = 0, above: tuple = ()) -> Any:
    """The value as it is stored, or an error that names the place of what cannot be."""
    if depth + isinstance(v, datetime.datetime) > DEPTH:
        raise DocError(f"'{path}' is nested more than {DEPTH} levels deep")
    if isinstance(v, dict):
        if any(v is x for x in above):
            raise DocError(f"'{path}' refers to itself")
        if set(v) in ({"$date"}, {"$binary"}):
            raise DocError(f"'{path}' looks like an encoded {next(iter(v))[1:]}")
        out = {}
        for k, x in v.items():
            if not isinstance(k, str):
                raise DocError(f"'{path}' has a key that is no string")
            out[k] = validate(x, f"{path}.{k}" if path else k, depth + 1, (*above, v))
        return out
    if isinstance(v, (list, tuple)):
        if any(v is x for x in above):
            raise DocError(f"'{path}' refers to itself")
        return [validate(x, f"{path}.{i}", depth + 1, (*above, v)) for i, x in enumerate(v)]
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        raise DocError(f"'{path}' is not a finite number")
    if v is None or isinstance(v, (bool, int, float, str, bytes, bytearray, datetime.date)):
        return v
    raise DocError(f"'{path}' holds a {type(v).__name__}, which cannot be stored")


def encode(v: Any) -> Any:
    """Extended JSON: dates and binary values as marked objects."""
    if isinstance(v, dict):
        return {k: encode(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [encode(x) for x in v]
    if isinstance(v, datetime.datetime):
        utc = v.astimezone(datetime.timezone.utc) if v.tzinfo else v
        return {"$date": utc.strftime("%Y-%m-%dT%H:%M:%S.") + f"{utc.microsecond // 1000:03d}Z"}
    if isinstance(v, (bytes, bytearray)):
        return {"$binary": {"base64": base64.b64encode(v).decode(), "subType": "00"}}
    return v


def decode(v: Any) -> Any:
    if isinstance(v, dict):
        if set(v) == {"$date"}:
            return datetime.datetime.fromisoformat(v["$date"].replace("Z", "+00:00")).replace(tzinfo=None)
        if set(v) == {"$binary"}:
            return base64.b64decode(v["$binary"]["base64"])
        return {k: decode(x) for k, x in v.items()}
    if isinstance(v, list):
        return [decode(x) for x in v]
    return v


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Extended-JSON lines as typed columns; dates and binary values become those types."""
    raw = spark.read.json(path)
    columns = [_revived(Value(F.col(f"`{f.name}`"), f.dataType)).col.alias(f.name) for f in raw.schema.fields]
    return raw.select(*columns)


def _revived(v: Value) -> Value:
    t = v.type
    if isinstance(t, T.StructType):
        if t.names == ["$date"]:
            return Value(F.to_timestamp_ntz(F.regexp_replace(v.col["$date"], "Z$", "")), T.TimestampNTZType())
        if t.names == ["$binary"]:
            return Value(F.unbase64(v.col["$binary"]["base64"]), T.BinaryType())
        inner = {f.name: _revived(Value(v.col[f.name], f.dataType)) for f in t.fields}
        kind = T.StructType([T.StructField(n, x.type) for n, x in inner.items()])
        return Value(F.when(v.col.isNotNull(), F.struct(*[x.col.alias(n) for n, x in inner.items()])), kind)
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
        probe = _revived(Value(F.lit(None).cast(t.elementType), t.elementType))
        return Value(F.transform(v.col, lambda x: _revived(Value(x, t.elementType)).col), T.ArrayType(probe.type))
    return v


def to_frame(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Documents as rows; the type of a field holds all its values, and a hidden column the paths of nulls."""
    schema = V.common([V.literal_type(d) for d in docs]) if docs else T.StructType()
    if not isinstance(schema, T.StructType):
        raise CompileError("documents are dictionaries")
    schema = _storable(schema)
    rows, nulls = [_row(d, schema) for d in docs], [V.null_paths(d) for d in docs]
    if any(nulls):
        schema = T.StructType([*schema.fields, T.StructField(NULLS, T.ArrayType(V.STRING))])
        rows = [(*r, n) for r, n in zip(rows, nulls)]
    return spark.createDataFrame(rows, schema)


#: Mark of fields, stored as strings or lists of strings, that no document has a value or an element in
_UNKNOWN = {"docloom.unknown": True}


def _storable(t: T.DataType, widen: bool = True) -> T.DataType:
    """The type with a stored one for each unknown one; ``widen``: whole numbers as longs."""
    if isinstance(t, T.StructType):
        unknown = lambda d: isinstance(d.elementType if isinstance(d, T.ArrayType) else d, T.NullType)
        return T.StructType([T.StructField(f.name, _storable(f.dataType, widen), metadata=_UNKNOWN if unknown(f.dataType) else None) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_storable(t.elementType, widen))
    return V.STRING if isinstance(t, T.NullType) else V.LONG if widen and isinstance(t, T.IntegerType) else t


def _known(t: T.DataType) -> T.DataType:
    """The type with ``NullType`` where no value is known."""
    if isinstance(t, T.StructType):
        types = [(T.ArrayType(V.NULL) if isinstance(f.dataType, T.ArrayType) else V.NULL) if f.metadata == _UNKNOWN else _known(f.dataType) for f in t.fields]
        return T.StructType([T.StructField(f.name, d) for f, d in zip(t.fields, types)])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_known(t.elementType))
    return t


def _row(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(_row(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [_row(x, t.elementType) for x in v]
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.BinaryType):
        return bytearray(v)
    if isinstance(t, T.StringType):
        return str(v)
    return v


def from_row(row: Any) -> Any:
    """A row as a document; missing fields are absent."""
    if hasattr(row, "asDict"):
        doc = {k: from_row(row[k]) for k in row.__fields__ if row[k] is not None and k not in (ORDER, NULLS)}
        for path in (row[NULLS] or ()) if NULLS in row.__fields__ else ():
            _set_null(doc, row, path.split("."))
        return doc
    if isinstance(row, dict):
        return {k: from_row(x) for k, x in row.items()}
    if isinstance(row, list):
        return [from_row(x) for x in row]
    return bytes(row) if isinstance(row, bytearray) else row


def _set_null(doc: Any, row: Any, way: list[str]) -> None:
    """The null at the end of the way, if the row has the field and no value there."""
    if row is None or way[0] not in getattr(row, "__fields__", ()):
        return
    if len(way) == 1:
        doc.setdefault(way[0], None)
    else:
        _set_null(doc.get(way[0]), row[way[0]], way[1:])


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, under a schema that holds both."""
    known = V.common([_known(a.schema), _known(b.schema)])
    t = _storable(known, widen=False)
    parts = []
    for df in (a, b):
        own = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in _known(df.schema).fields}
        parts.append(df.select(*[V.cast(own.get(f.name, V.missing()), f.dataType).alias(f.name) for f in t.fields]))
    out = parts[0].unionByName(parts[1])
    return out.to(t) if t != known else out


def local_folder(spark: SparkSession) -> str:
    """A temporary folder, where all executors are on this machine; an error on a cluster."""
    if not spark.sparkContext.master.startswith("local"):
        raise DocError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="docloom-")


class Versions:
    """Where versions of collections are kept: parquet below a path, or checkpoints.

    A version is a folder ``v-…`` and the folders ``a-…`` of later appends.  Folders are
    listed and removed by the path's own file system.
    """

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _list(self, path: str) -> list[str]:
        files, place = self._files(path)
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def remove(self, name: str) -> None:
        files, place = self._files(f"{self.path}/{name}")
        files.delete(place, True)

    def store(self, name: str, df: DataFrame, *, append: bool = False) -> DataFrame:
        """``df``, stored; ``append``: as further rows of the version before."""
        if self.path:
            place = f"{self.path}/{name}/{'a' if append else 'v'}-{time.time_ns()}"
            df.write.parquet(place)
            return self.spark.read.schema(df.schema).parquet(place)
        context = self.spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or local_folder(self.spark))
        return df.checkpoint(eager=True)

    def names(self) -> Iterable[str]:
        if self.path:
            yield from (n for n in self._list(self.path) if not n.startswith("_"))

    def latest(self, name: str) -> DataFrame | None:
        folder = f"{self.path}/{name}"
        if name.endswith(".parquet"):
            return self.spark.read.parquet(folder)
        kept = sorted((n for n in self._list(folder) if n.startswith(("v-", "a-"))), key=lambda n: n[2:])
        if not kept:
            return None
        start = max((i for i, n in enumerate(kept) if n.startswith("v-")), default=0)
        parts = [self.spark.read.parquet(f"{folder}/{n}") for n in kept[start:]]
        return reduce(merged, parts)


def as_json(v: Any) -> str:
    return json.dumps(encode(v), ensure_ascii=False)


__all__ = ["ID", "ObjectId", "Versions", "as_json", "decode", "encode", "from_row", "merged", "read_json_lines", "to_frame", "validate"]
