"""Collections: DataFrames with find, aggregate, writes, indexes and search.

A collection is an immutable version of a DataFrame.  Reads build on it lazily.  A write
makes a new version in one pass over the old one, after one pass of checks.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CompileError, DocError, DuplicateKey, WriteRefused
from .functions import Context
from .operators import ordering, search
from .operators.filters import matches
from .operators.pipeline import Scope, run_pipeline, visible
from .operators.projection import ID, ORDER, add_fields, find_projection, stage_projection, unset
from .operators.updates import Update, compile_update, seed
from .plans import paths
from .plans import values as V
from .plans.values import NULLS, Value
from .sources.documents import ObjectId, from_row, merged, to_frame, validate


#: Appended parts that a version may have before it is written anew
APPENDS = 16


@dataclass
class State:
    """One version of a collection; what a transaction restores."""

    df: DataFrame | None = None
    next_order: int = 0
    appends: int = 0
    indexes: dict[str, dict] = field(default_factory=dict)
    search: dict[str, dict] = field(default_factory=dict)


class Cursor:
    """A lazy query; its setters work until it is first read."""

    def __init__(self, c: Collection, query: dict, projection: dict | None = None, **options: Any):
        self._c, self._query, self._projection = c, query, projection
        self._sort, self._limit, self._skip = None, 0, 0
        self._map: Callable | None = None
        self._rows: Iterator | None = None
        for k, v in options.items():
            if k not in ("sort", "limit", "skip", "hint"):
                raise CompileError(f"unknown option {k}")
            getattr(self, k)(v)

    def _set(self, **own: Any) -> Cursor:
        if self._rows is not None:
            raise DocError("the cursor has been read")
        self.__dict__.update(own)
        return self

    def sort(self, spec: dict | str, direction: int = 1) -> Cursor:
        return self._set(_sort={spec: direction} if isinstance(spec, str) else spec)

    def limit(self, n: int) -> Cursor:
        return self._set(_limit=abs(int(n)))

    def skip(self, n: int) -> Cursor:
        if n < 0:
            raise CompileError("skip is not negative")
        return self._set(_skip=int(n))

    def project(self, spec: dict) -> Cursor:
        return self._set(_projection=spec)

    def hint(self, name: str | None) -> Cursor:
        if name is not None and name not in self._c.state.indexes and name != "_id_":
            raise DocError(f"there is no index {name}")
        return self

    def map(self, f: Callable) -> Cursor:
        old = self._map
        return self._set(_map=f if old is None else lambda d: f(old(d)))

    def _window(self, natural: bool = False) -> DataFrame:
        """The matching rows; they are sorted if a sort or a window asks for it, or the ``natural`` order is wanted."""
        df = self._c.source
        c = self._c.context(df)
        df = df.where(matches_or_all(c, self._query))
        if self._sort or self._limit or self._skip:
            df = df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())
        elif not natural or ORDER not in df.columns:  # a scan is in its own order
            return df
        terms = ordering.columns(ordering.terms(c, self._sort)) if self._sort else []
        df = df.orderBy(*terms, F.col(ORDER))
        df = df.offset(self._skip) if self._skip else df
        return df.limit(self._limit) if self._limit else df

    def df(self, natural: bool = False) -> DataFrame:
        """The query as a DataFrame; sorted only as far as the query says, or by the ``natural`` order."""
        return self._documents(natural).drop(NULLS)

    def _documents(self, natural: bool) -> DataFrame:
        df = self._window(natural)
        if self._projection:
            df = find_projection(df, self._c.context(df), self._projection, self._query)
        return df.drop(ORDER)

    def count(self) -> int:
        return self._window().count()

    def to_list(self) -> list:
        return list(self)

    to_array = to_list

    def __iter__(self) -> Iterator:
        if self._rows is None:
            self._rows = (self._map(d) if self._map else d for d in map(from_row, self._documents(natural=True).toLocalIterator()))
        return self._rows

    def next(self) -> Any:
        return next(iter(self), None)

    def for_each(self, f: Callable) -> None:
        for d in self:
            f(d)

    def explain(self) -> str:
        return self.df()._jdf.queryExecution().toString()


def matches_or_all(c: Context, query: dict):
    from .operators.filters import compile_filter

    return compile_filter(c, query) if query else F.lit(True)


class Collection:
    def __init__(self, db, name: str):
        self.db, self.name, self.state = db, name, State()

    # --- reading --------------------------------------------------------------------

    @property
    def source(self) -> DataFrame:
        """All documents, with the hidden order column if they have one."""
        df = self.state.df
        if df is None:
            return self.db.spark.createDataFrame([], T.StructType([T.StructField(ID, T.StringType()), T.StructField(ORDER, T.LongType())]))
        return df

    @property
    def frame(self) -> DataFrame:
        """All documents, numbered in their order."""
        df = self.source
        return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())

    def context(self, df: DataFrame | None = None) -> Context:
        df = self.frame if df is None else df
        return Context(visible(df), strict=self.db.strict, nulls=NULLS in df.columns)

    def find(self, query: dict | None = None, projection: dict | None = None, **options: Any) -> Cursor:
        return Cursor(self, query or {}, projection, **options)

    def find_one(self, query: dict | str | None = None, projection: dict | None = None, **options: Any) -> dict | None:
        query = {ID: query} if isinstance(query, str) else query
        return next(iter(self.find(query, projection, **options).limit(1)), None)

    def aggregate(self, pipeline: list[dict]) -> DataFrame:
        scope = Scope(lambda name: self.db.collection(name).source, strict=self.db.strict)
        return run_pipeline(self.source, pipeline, scope).drop(ORDER, NULLS)

    def count_documents(self, query: dict | None = None, **window: Any) -> int:
        return self.find(query, **window).count()

    def estimated_document_count(self) -> int:
        return self.source.count()

    def distinct(self, path: str, query: dict | None = None) -> list:
        df = self.source
        c = self.context(df)
        v = paths.plain(c.root, path, c.strict)
        if v.kind == "null":
            return []
        rows = df.where(matches_or_all(c, query or {}))
        rows = rows.select(F.explode(v.col).alias("v")) if v.kind == "array" else rows.where(v.present).select(v.col.alias("v"))
        return [from_row(r.v) for r in rows.distinct().orderBy("v").collect()]

    # --- versions -------------------------------------------------------------------

    def _put(self, df: DataFrame, next_order: int | None = None) -> None:
        stored = self.db.versions.store(self.name, df)
        self.state = replace(self.state, df=stored, next_order=self.state.next_order if next_order is None else next_order, appends=0)

    def _put_more(self, rows: DataFrame, df: DataFrame, next_order: int) -> None:
        """Store further rows next to the old ones; after ``APPENDS`` times all rows, ``df``, anew."""
        if self.state.df is None or self.state.appends >= APPENDS or ORDER not in self.source.columns:
            self._put(df, next_order)
            return
        stored = self.db.versions.store(self.name, rows, append=True)
        self.state = replace(self.state, df=merged(self.source, stored), next_order=next_order, appends=self.state.appends + 1)

    @property
    def _watched(self) -> bool:
        return self.db.watched

    def _event(self, kind: str, **more: Any) -> dict:
        return {"operationType": kind, "wallTime": datetime.datetime.now(), "ns": {"db": self.db.name, "coll": self.name}, **more}

    # --- inserts --------------------------------------------------------------------

    def insert_one(self, doc: dict) -> dict:
        got = self.insert_many([doc])
        return {"acknowledged": True, "inserted_id": got["inserted_ids"][0]}

    def insert_many(self, docs: list[dict], *, ordered: bool = True) -> dict:
        """All documents, or with a duplicate the ones before it (``ordered``) or all others."""
        if not docs:
            raise CompileError("there is nothing to insert")
        kept, seen, failed = [], set(), []
        for i, d in enumerate(docs):
            if d.get(ID) is None:
                d[ID] = str(ObjectId())
            if isinstance(d[ID], (list, tuple)):
                raise DocError("_id cannot be an array")
            stored = validate(d)
            key = repr(stored[ID])
            if key in seen:
                failed.append(i)
                if ordered:
                    break
                continue
            seen.add(key)
            kept.append((i, stored))
        new = to_frame(self.db.spark, [d for _, d in kept])
        taken = self._taken(new, [d[ID] for _, d in kept])
        if taken:
            first = min(i for i, d in kept if repr(d[ID]) in taken)
            failed += [i for i, d in kept if repr(d[ID]) in taken]
            kept = [(i, d) for i, d in kept if (i < first if ordered else repr(d[ID]) not in taken)]
        if kept:
            self._append([d for _, d in kept])
        result = {"acknowledged": True, "inserted_count": len(kept), "inserted_ids": {i: d[ID] for i, d in kept}}
        if failed:
            at = min(failed) if ordered else sorted(failed)
            raise DuplicateKey(f"duplicate _id in {self.name} at document {at}", result)
        return result

    def insert_frame(self, df: DataFrame) -> int:
        """All rows of a frame that has an ``_id``, without passing the driver; the number of rows.

        Repeated ids, in the frame or in the collection, are an error, and nothing is written.
        """
        if ID not in df.columns:
            raise CompileError("a frame needs a column _id")
        start = self.state.next_order
        rows = df.drop(ORDER).withColumn(ORDER, F.monotonically_increasing_id() + F.lit(start))
        counts = rows.agg(F.count("*").alias("n"), F.count(ID).alias("given")).first()
        if counts.given < counts.n:
            raise DocError("a row has no _id")
        if not rows.groupBy(ID).count().where("count > 1").isEmpty():
            raise DuplicateKey(f"duplicate _id in {self.name}")
        old = self.state.df
        if old is not None and ID in old.columns and not rows.join(old.select(F.col(ID).alias("_old")), F.col(ID) == F.col("_old"), "left_semi").isEmpty():
            raise DuplicateKey(f"duplicate _id in {self.name}")
        every = rows if old is None else merged(self.frame, rows)
        self._check_unique(every)
        # numbers of a frame leave gaps, and later rows follow the last possible one
        self._put_more(rows, every, start + (rows.rdd.getNumPartitions() << 33))
        if self._watched:
            added = self.frame.where(F.col(ORDER) >= start)
            self.db.publish_frame(self._event("insert"), added.orderBy(ORDER).drop(ORDER, NULLS), None)
        return counts.n

    def _taken(self, new: DataFrame, ids: list) -> set[str]:
        """Which of the ids the collection has."""
        if self.state.df is None or ID not in self.frame.columns:
            return set()
        if V.kind(new.schema[ID].dataType) != V.kind(self.frame.schema[ID].dataType):
            return set()
        if not isinstance(new.schema[ID].dataType, T.StructType) and len(ids) <= 1000:
            rows = self.frame.where(F.col(ID).isin(ids)).select(ID)
        else:
            rows = self.frame.join(new.select(ID), ID, "left_semi").select(ID)
        return {repr(from_row(r[0])) for r in rows.collect()}

    def _append(self, docs: list[dict]) -> None:
        start = self.state.next_order
        rows = to_frame(self.db.spark, [{**d, ORDER: start + i} for i, d in enumerate(docs)])
        df = rows if self.state.df is None else merged(self.frame, rows)
        self._check_unique(df)
        self._put_more(rows, df, start + len(docs))
        if self._watched:
            self.db.publish([self._event("insert", documentKey={ID: d[ID]}, fullDocument=d) for d in docs])

    # --- updates --------------------------------------------------------------------

    def update_one(self, query: dict, update: dict | list, *, upsert: bool = False, array_filters: list | None = None) -> dict:
        return self._update(query, update, True, upsert, array_filters)

    def update_many(self, query: dict, update: dict | list, *, upsert: bool = False, array_filters: list | None = None) -> dict:
        return self._update(query, update, False, upsert, array_filters)

    def _first(self, hit, sort: dict | None = None):
        """The matched rows narrowed to the first one, and its place in the natural order."""
        df = self.frame.where(hit)
        if sort:
            df = df.orderBy(*ordering.columns(ordering.terms(self.context(), sort)), ORDER).limit(1)
            row = df.select(ORDER).first()
        else:
            row = df.agg(F.min(ORDER)).first()
        at = row[0] if row else None
        return (F.col(ORDER) == at if at is not None else F.lit(False)), at

    def _new_values(self, update: dict | list, query: dict, array_filters) -> Update:
        c = self.context()
        if isinstance(update, list):
            return Update(self._pipeline_values(update), [], [], *_pipeline_nulls(update, c.schema.names))
        return compile_update(c, update, query, array_filters)

    def _pipeline_values(self, stages: list[dict]) -> dict[str, Value | None]:
        """What a pipeline of ``$set``, ``$unset`` and ``$project`` makes of each document."""
        shape = self.frame
        whole = F.struct(*[F.col(paths.quoted(n)) for n in shape.columns])
        df = shape.select(whole.alias("_old"), *[F.col(paths.quoted(n)) for n in shape.columns])
        values = {f.name: Value(F.col(paths.quoted(f.name)), f.dataType) for f in visible(shape).fields}
        for stage in stages:
            ((name, arg),) = stage.items()
            if name not in ("$set", "$addFields", "$unset", "$project"):
                raise CompileError(f"{name} is not allowed in an update")
            t = T.StructType([T.StructField(n, v.type) for n, v in values.items()])
            row = F.struct(*[v.col.alias(n) for n, v in values.items()])
            c = Context(t, prefix=row, strict=self.db.strict)
            values = _captured(name, df, c, arg)
        values.pop(ID, None)
        gone = {f.name: None for f in visible(shape).fields if f.name not in values and f.name != ID}
        return {**values, **gone}

    def _update(self, query, update, one, upsert, array_filters) -> dict:
        query = query or {}
        if isinstance(update, dict) and array_filters is None:
            array_filters = []
        c = self.context()
        hit = matches(c, query)
        if one:
            hit, _ = self._first(hit)
        new = self._new_values(update, query, array_filters)
        guards, df = new.guards, self.frame
        out, changed = _rewritten(df, hit, new)
        counts = df.agg(F.count_if(hit).alias("n"), F.count_if(hit & changed).alias("m"), *[F.count_if(hit & V.true(g.fault)).alias(f"g{i}") for i, g in enumerate(guards)]).first()
        for i, g in enumerate(guards):
            if counts[f"g{i}"]:
                raise WriteRefused(g.message)
        result = {"acknowledged": True, "matched_count": counts.n, "modified_count": counts.m, "upserted_count": 0, "upserted_id": None}
        if not counts.n and upsert:
            doc = self._upserted(query, update, array_filters)
            self._append([doc])
            return {**result, "upserted_count": 1, "upserted_id": doc[ID]}
        if counts.m:
            pairs = self._pairs(df, out, hit & changed) if self._watched else []
            self._check_unique(out)
            self._put(out)
            described = [self._described(a, b, "update") for a, b in pairs]
            self.db.publish(described)
        return result

    def _pairs(self, df, out, hit) -> list[tuple[dict, dict]]:
        keys = [r[0] for r in df.where(hit).select(ORDER).orderBy(ORDER).collect()]
        pick = F.col(ORDER).isin(keys)
        old, new = ([from_row(r) for r in x.where(pick).orderBy(ORDER).drop(ORDER).collect()] for x in (df, out))
        return list(zip(old, new))

    def _described(self, old: dict, new: dict, kind: str) -> dict:
        from .streaming.changes import difference

        more = {"updateDescription": difference(old, new)} if kind == "update" else {}
        return self._event(kind, documentKey={ID: new.get(ID)}, fullDocument=new, fullDocumentBeforeChange=old, **more)

    def _upserted(self, query, update, array_filters) -> dict:
        base = seed(query)
        base.setdefault(ID, str(ObjectId()))
        one = to_frame(self.db.spark, [base])
        if isinstance(update, list):
            twin = Collection(self.db, self.name)
            twin.state = State(one.withColumn(ORDER, F.lit(0).cast("long")))
            values, guards, nulled = twin._pipeline_values(update), [], _pipeline_nulls(update, base)[1]
        else:
            got = compile_update(Context(visible(one)), update, query, array_filters, inserting=True)
            values, guards, nulled = got.values, [g for g in got.guards if g.message != "_id cannot change"], got.nulled
        fields = {f.name: Value(F.col(paths.quoted(f.name)), f.dataType) for f in one.schema.fields} | values
        row = one.select(*[v.col.alias(n) for n, v in fields.items() if v is not None], *[V.true(g.fault).alias(f"_g{i}") for i, g in enumerate(guards)]).first()
        for i, g in enumerate(guards):
            if row[f"_g{i}"]:
                raise WriteRefused(g.message)
        doc = {k: v for k, v in from_row(row).items() if not k.startswith("_g")}
        for path in nulled:
            *way, last = path.split(".")
            inner = doc
            for p in way:
                inner = inner.setdefault(p, {})
            inner.setdefault(last, None)
        return doc

    def replace_one(self, query: dict, doc: dict, *, upsert: bool = False) -> dict:
        if any(k.startswith("$") for k in doc):
            raise CompileError("a replacement has no operators")
        stored = validate(doc)
        hit, at = self._first(matches(self.context(), query or {}))
        if at is None:
            if not upsert:
                return {"acknowledged": True, "matched_count": 0, "modified_count": 0, "upserted_count": 0, "upserted_id": None}
            new = {**{k: v for k, v in seed(query).items() if k == ID}, **stored}
            new.setdefault(ID, str(ObjectId()))
            self._append([new])
            return {"acknowledged": True, "matched_count": 0, "modified_count": 0, "upserted_count": 1, "upserted_id": new[ID]}
        old = from_row(self.frame.where(hit).drop(ORDER).first())
        if ID in stored and stored[ID] != old[ID]:
            raise WriteRefused("_id cannot change")
        new = {**stored, ID: old[ID]}
        if new != old:
            df = merged(self.frame.where(~hit), to_frame(self.db.spark, [{**new, ORDER: at}]))
            self._check_unique(df)
            self._put(df)
            self.db.publish([self._described(old, new, "replace")] if self._watched else [])
        return {"acknowledged": True, "matched_count": 1, "modified_count": int(new != old), "upserted_count": 0, "upserted_id": None}

    # --- deletes and single-document commands ---------------------------------------

    def _delete(self, hit) -> int:
        n = self.frame.where(hit).count()
        if n:
            gone = self.frame.where(hit).orderBy(ORDER).drop(ORDER, NULLS)
            self._put(self.frame.where(~hit))
            if self._watched:
                self.db.publish_frame(self._event("delete"), None, gone)
        return n

    def delete_many(self, query: dict) -> dict:
        return {"acknowledged": True, "deleted_count": self._delete(matches(self.context(), query or {}))}

    def delete_one(self, query: dict) -> dict:
        hit, at = self._first(matches(self.context(), query or {}))
        return {"acknowledged": True, "deleted_count": self._delete(hit) if at is not None else 0}

    def _one(self, at: int, projection: dict | None) -> dict | None:
        df = self.frame.where(F.col(ORDER) == at)
        if projection:
            df = find_projection(df, self.context(df), projection)
        row = df.drop(ORDER).first()
        return from_row(row) if row else None

    def find_one_and_update(self, query, update, *, sort=None, projection=None, upsert=False, return_document="before", array_filters=None):
        _, at = self._first(matches(self.context(), query or {}), sort)
        before = self._one(at, projection) if at is not None else None
        if at is None:
            if not upsert:
                return None
            self._update(query, update, True, True, array_filters)
            return self._one(self.state.next_order - 1, projection) if return_document == "after" else None
        key = from_row(self.frame.where(F.col(ORDER) == at).select(ID).first()).get(ID)
        self._update({"$and": [query or {}, {ID: key}]} if query else {ID: key}, update, True, False, array_filters)
        return self._one(at, projection) if return_document == "after" else before

    def find_one_and_replace(self, query, doc, *, sort=None, projection=None, upsert=False, return_document="before"):
        _, at = self._first(matches(self.context(), query or {}), sort)
        if at is None:
            if upsert:
                self.replace_one(query, doc, upsert=True)
                return self._one(self.state.next_order - 1, projection) if return_document == "after" else None
            return None
        before = self._one(at, projection)
        key = from_row(self.frame.where(F.col(ORDER) == at).select(ID).first()).get(ID)
        self.replace_one({ID: key}, doc)
        return self._one(at, projection) if return_document == "after" else before

    def find_one_and_delete(self, query, *, sort=None, projection=None):
        hit, at = self._first(matches(self.context(), query or {}), sort)
        if at is None:
            return None
        before = self._one(at, projection)
        self._delete(hit)
        return before

    def bulk_write(self, operations: list[dict], *, ordered: bool = True) -> dict:
        total = {"inserted_count": 0, "matched_count": 0, "modified_count": 0, "deleted_count": 0, "upserted_count": 0, "upserted_ids": {}, "inserted_ids": {}}
        errors = []
        done = 0
        for i, op in enumerate(operations):
            ((name, a),) = op.items()
            if i < done:
                continue
            try:
                if name == "insert_one":  # as many as follow each other are one append
                    got = {"inserted_count": 0, "inserted_ids": {}}
                    done = next((k for k in range(i, len(operations)) if "insert_one" not in operations[k]), len(operations))
                    try:
                        got = self.insert_many([o["insert_one"]["document"] for o in operations[i:done]], ordered=ordered)
                    except DuplicateKey as e:
                        got = e.result
                        raise
                    finally:
                        total["inserted_count"] += got["inserted_count"]
                        total["inserted_ids"].update({i + k: v for k, v in got["inserted_ids"].items()})
                    continue
                more = {k: a[k] for k in ("upsert", "array_filters") if k in a}
                if name in ("update_one", "update_many"):
                    got = getattr(self, name)(a["filter"], a["update"], **more)
                elif name == "replace_one":
                    got = self.replace_one(a["filter"], a["replacement"], **more)
                elif name in ("delete_one", "delete_many"):
                    got = getattr(self, name)(a["filter"])
                else:
                    raise CompileError(f"unknown operation {name}")
                for k in ("matched_count", "modified_count", "deleted_count", "upserted_count"):
                    total[k] += got.get(k, 0)
                if got.get("upserted_count"):
                    total["upserted_ids"][i] = got["upserted_id"]
            except DocError as e:
                e.result = {**total, "failed_at": i + len([k for k in total["inserted_ids"] if i <= k < done])}
                if ordered or isinstance(e, CompileError):
                    raise
                errors.append(e)
        if errors:
            errors[0].result = total
            raise errors[0]
        return total

    # --- indexes --------------------------------------------------------------------

    def create_index(self, keys: dict | str, *, unique: bool = False, sparse: bool = False, partial_filter: dict | None = None, name: str | None = None, **odd: Any) -> str:
        """Metadata, and the promise of unique values; parquet statistics do the pruning."""
        if odd:
            raise CompileError(f"index option {next(iter(odd))} is not supported")
        keys = {keys: 1} if isinstance(keys, str) else keys
        if not keys or any(d not in (1, -1) for d in keys.values()):
            raise CompileError("an index needs fields with 1 or -1")
        if partial_filter and (bad := [k for k in partial_filter if k.startswith("$") and k not in ("$and", "$or")]):
            raise CompileError(f"{bad[0]} is not allowed in a partial index")
        name = name or "_".join(f"{k}_{d}" for k, d in keys.items())
        spec = {"name": name, "key": keys, "unique": unique, "sparse": sparse, "partial_filter": partial_filter}
        old = self.state.indexes.get(name)
        if old and old != spec:
            raise DocError(f"an index {name} exists with other options", 86)
        self.state = replace(self.state, indexes={**self.state.indexes, name: spec})
        try:
            self._check_unique(self.frame)
        except DuplicateKey:
            self.state = replace(self.state, indexes={k: v for k, v in self.state.indexes.items() if k != name})
            raise
        return name

    def _check_unique(self, df: DataFrame) -> None:
        for spec in self.state.indexes.values():
            if not spec["unique"]:
                continue
            c = self.context(df)
            own = [paths.plain(c.root, k) for k in spec["key"]]
            rows = df.where(matches(c, spec["partial_filter"])) if spec["partial_filter"] else df
            if spec["sparse"]:
                rows = rows.where(V.any_of([v.col.isNotNull() for v in own]))
            keys = [V.sort_key(v).alias(f"k{i}") for i, v in enumerate(own)]
            if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
                raise DuplicateKey(f"duplicate key in index {spec['name']} of {self.name}")

    def create_indexes(self, specs: list[dict]) -> list[str]:
        return [self.create_index(s["key"], **{k: v for k, v in s.items() if k != "key"}) for s in specs]

    def drop_index(self, name: str) -> None:
        if name not in self.state.indexes:
            raise DocError(f"there is no index {name}", 27)
        self.state = replace(self.state, indexes={k: v for k, v in self.state.indexes.items() if k != name})

    def drop_indexes(self) -> None:
        self.state = replace(self.state, indexes={})

    def index_exists(self, name: str) -> bool:
        return name == "_id_" or name in self.state.indexes

    def list_indexes(self) -> list[dict]:
        return [{"name": "_id_", "key": {ID: 1}, "unique": True}, *self.state.indexes.values()]

    # --- search ---------------------------------------------------------------------

    def create_search_index(self, name: str, fields: list[str], *, tokenizer: str = "unicode61") -> str:
        if not fields:
            raise CompileError("a search index needs fields")
        if tokenizer not in search.TOKENIZERS:
            raise CompileError(f"unknown tokenizer {tokenizer}")
        if name in self.state.search:
            raise DocError(f"a search index {name} exists", 68)
        self.state = replace(self.state, search={**self.state.search, name: {"name": name, "fields": list(fields), "tokenizer": tokenizer}})
        return name

    def drop_search_index(self, name: str) -> None:
        if name not in self.state.search:
            raise DocError(f"there is no search index {name}", 27)
        self.state = replace(self.state, search={k: v for k, v in self.state.search.items() if k != name})

    def list_search_indexes(self) -> list[dict]:
        return list(self.state.search.values())

    def search_text(self, query: str, *, index: str | None = None, limit: int | None = None, skip: int = 0) -> DataFrame:
        if not self.state.search or index is not None and index not in self.state.search:
            raise DocError("there is no such search index", 27)
        if index is None and len(self.state.search) > 1:
            raise DocError("there are several search indexes: name one")
        spec = self.state.search[index or next(iter(self.state.search))]
        df = self.frame
        return search.search(df, self.context(df), spec["fields"], query, spec["tokenizer"], limit=limit, skip=skip, order=ORDER).drop(ORDER, NULLS)

    # --- administration -------------------------------------------------------------

    def drop(self) -> bool:
        return self.db.drop_collection(self.name)

    def rename(self, name: str) -> None:
        self.db.rename_collection(self.name, name)

    def stats(self) -> dict:
        return {"ns": f"{self.db.name}.{self.name}", "count": self.frame.count(), "indexes": len(self.list_indexes()), "search_indexes": len(self.state.search)}

    def watch(self, pipeline: list[dict] | None = None, **options: Any):
        return self.db._watch({"db": self.db.name, "coll": self.name}, pipeline, options)


def _captured(name: str, df: DataFrame, c: Context, arg: Any) -> dict[str, Value]:
    """Columns that a projection stage would select, as values over the row."""
    got = {}

    class Catch:
        columns: list = []

        def select(self, *columns):
            got["columns"] = columns
            return self

    f = {"$set": add_fields, "$addFields": add_fields, "$project": stage_projection, "$unset": unset}[name]
    f(Catch(), c, arg)
    frame = df.select(*got["columns"])
    return {field.name: Value(col, field.dataType) for field, col in zip(frame.schema.fields, got["columns"])}


def _pipeline_nulls(stages: list[dict], names) -> tuple[list[str], list[str]]:
    """Paths whose nulls a pipeline update removes, and those that it sets to null."""
    cleared, nulled = [], []
    for stage in stages:
        ((name, arg),) = stage.items()
        if name == "$unset":
            gone, new = [arg] if isinstance(arg, str) else list(arg), []
        elif name == "$project":
            out = {k for k, v in arg.items() if v is False or v == 0}
            kept = {k.split(".")[0] for k in arg}
            gone, new = [n for n in names if n in out or not out and n not in kept and n != ID], []
        else:
            gone, new = list(arg), [k for k, v in arg.items() if v is None]
        nulled = [p for p in nulled if p not in gone] + new
        cleared += gone
    return cleared, nulled


def _nulls_after(df: DataFrame, update: Update):
    """The paths of nulls before and after an update."""
    old = F.array().cast("array<string>")
    if NULLS in df.columns:
        old = F.coalesce(F.col(NULLS), old)
    new = old
    if update.cleared:
        stays = lambda p: ~V.any_of([(p == t) | p.startswith(t + ".") | F.lit(t).startswith(F.concat(p, F.lit("."))) for t in update.cleared])
        new = F.filter(old, stays)
    return old, F.array_distinct(F.concat(new, F.array(*map(F.lit, update.nulled)).cast("array<string>")))


def _rewritten(df: DataFrame, hit, update: Update) -> tuple[DataFrame, Any]:
    """The new version, and whether a row's values differ from the old ones."""
    columns, differs, values = [], [], update.values
    if update.nulled or update.cleared and NULLS in df.columns:
        before, after = _nulls_after(df, update)
        differs.append(F.array_sort(before) != F.array_sort(after))
        columns.append(F.when(hit, after).otherwise(before).alias(NULLS))
        fresh = [p for p in update.nulled if "." not in p and p not in df.columns]
        columns += [F.lit(None).cast("string").alias(p) for p in fresh if values.get(p) is None or values[p].kind == "null"]
    for f in df.schema.fields:
        if f.name == NULLS and columns:
            continue
        old = Value(F.col(paths.quoted(f.name)), f.dataType)
        if f.name not in values:
            columns.append(old.col.alias(f.name))
            continue
        new = values[f.name] or Value(F.lit(None).cast(f.dataType), f.dataType)
        try:
            t = V.common([f.dataType, new.type])
        except CompileError:
            t = new.type  # the field changes its type: only if no other row has a value
            old = Value(F.when(old.col.isNotNull() & ~hit, F.raise_error(F.lit(f"'{f.name}' holds values of another kind"))).cast(t), t)
        a, b = V.cast(old, t), V.cast(new, t)
        same = F.to_json(F.struct(a)) == F.to_json(F.struct(b)) if isinstance(t, T.MapType) else a.eqNullSafe(b)
        differs.append(~same)
        columns.append(F.when(hit, b).otherwise(a).alias(f.name))
    for name, v in values.items():
        if name not in df.columns and v is not None and v.kind != "null":
            differs.append(v.col.isNotNull())
            columns.append(F.when(hit, v.col).alias(name))
    return df.select(*columns), V.any_of(differs)
