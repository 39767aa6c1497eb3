"""Databases, clients, sessions and transactions."""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection, State
from .errors import DocError
from .operators.projection import ORDER
from .plans.values import NULLS
from .sources.documents import Versions, local_folder
from .streaming.changes import ChangeLog, ChangeStream


# Beginnings of names that are not for users.
RESERVED = ("system.", "sqlite_")


def check_name(name: str) -> str:
    if not name or "\0" in name or "$" in name or name.startswith(RESERVED) or len(name) > 200:
        raise DocError(f"'{name}' is not a collection name", 73)
    return name


class Database:
    """Named collections over one session; with a path, their versions are kept as parquet there."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, name: str = "db", strict: bool = False):
        self.spark, self.name, self.strict, self.path = spark, name, strict, path
        self.versions = Versions(spark, path)
        self._collections: dict[str, Collection] = {}
        self._snapshots: list[tuple[dict, list]] = []
        self._log: ChangeLog | None = None
        self._pending: list[dict] = []
        for entry in self.versions.names():
            df = self.versions.latest(entry)
            if df is not None:
                self.register(entry.removesuffix(".parquet"), df)

    # --- collections ----------------------------------------------------------------

    def collection(self, name: str) -> Collection:
        if name not in self._collections:
            self._collections[check_name(name)] = Collection(self, name)
        return self._collections[name]

    __getitem__ = collection

    def register(self, name: str, df: DataFrame, order: str | None = None) -> Collection:
        """An existing DataFrame as a collection; ``order``: a column with the natural order.

        Without one the order is that of the scan, and is only numbered where a stage or
        a write asks for it, so that filters still reach the scan.
        """
        c = self.collection(name)
        if ORDER not in df.columns and order:
            df = df.withColumn(ORDER, F.col(order).cast("long"))
        c.state = State(df, 1 << 60)
        return c

    def create_collection(self, name: str) -> Collection:
        if name in self._collections:
            raise DocError(f"there is a collection {name}", 48)
        return self.collection(name)

    def list_collections(self) -> list[dict]:
        return [{"name": n, "type": "collection"} for n in sorted(self._collections)]

    def drop_collection(self, name: str) -> bool:
        there = self._collections.pop(name, None) is not None
        if there and self.path:
            self.versions.remove(name)
        if there:
            ns = {"db": self.name, "coll": name}
            self.publish([{"operationType": "drop", "ns": ns}, {"operationType": "invalidate", "ns": ns, "invalidateReason": "drop"}])
        return there

    def rename_collection(self, old: str, new: str) -> None:
        if old not in self._collections:
            raise DocError(f"there is no collection {old}", 26)
        if new in self._collections:
            raise DocError(f"there is a collection {new}", 48)
        c = self._collections.pop(old)
        c.name = check_name(new)
        self._collections[new] = c
        ns, to = {"db": self.name, "coll": old}, {"db": self.name, "coll": new}
        self.publish([{"operationType": "rename", "ns": ns, "to": to}, {"operationType": "invalidate", "ns": ns, "invalidateReason": "rename"}])

    def drop_database(self) -> None:
        for name in list(self._collections):
            self.drop_collection(name)
        self.publish([{"operationType": "dropDatabase", "ns": {"db": self.name, "coll": None}}])

    def stats(self) -> dict:
        return {"db": self.name, "collections": len(self._collections), "objects": sum(c.frame.count() for c in self._collections.values())}

    # --- SQL ------------------------------------------------------------------------

    def table(self, name: str) -> str:
        """A name under which SQL sees the collection."""
        if name not in self._collections:
            raise DocError(f"there is no collection {name}", 26)
        slug = re.sub(r"\W", "_", name.lower())[:40]
        view = f"{slug}_{hashlib.sha256(name.encode()).hexdigest()[:16]}"
        self._collections[name].frame.drop(ORDER, NULLS).createOrReplaceTempView(view)
        return f"`{view}`"

    def sql(self, query: str, **args: Any) -> DataFrame:
        """One statement with named parameters; values never become part of the text."""
        return self.spark.sql(query, args=args)

    # --- transactions ---------------------------------------------------------------

    def _snapshot(self) -> tuple[dict, list]:
        return {n: (c, c.state, c.name) for n, c in self._collections.items()}, list(self._pending)

    def begin(self) -> None:
        self._snapshots.append(self._snapshot())

    def commit(self) -> None:
        self._snapshots.pop()
        if not self._snapshots:
            self._flush()

    def rollback(self) -> None:
        kept, pending = self._snapshots.pop()
        self._collections = {}
        for n, (c, state, name) in kept.items():
            c.state, c.name = state, name
            self._collections[n] = c
        self._pending = pending

    def with_transaction(self, work: Callable[[Database], Any]) -> Any:
        """All writes of ``work`` or none; may be nested."""
        self.begin()
        try:
            out = work(self)
        except BaseException:
            self.rollback()
            raise
        self.commit()
        return out

    def start_session(self) -> ClientSession:
        return ClientSession(self)

    # --- change streams -------------------------------------------------------------

    @property
    def watched(self) -> bool:
        return self._log is not None and getattr(self._log, "watchers", 0) > 0

    def publish(self, events: list[dict]) -> None:
        if self.watched:
            self._pending += events
            if not self._snapshots:
                self._flush()

    def publish_frame(self, event: dict, after: DataFrame | None, before: DataFrame | None) -> None:
        """One event like ``event`` for each row of a frame; the rows never pass the driver."""
        if self.watched:
            self._pending.append((event, after, before))
            if not self._snapshots:
                self._flush()

    def _flush(self) -> None:
        events, self._pending = self._pending, []
        if self._log is None:
            return
        for framed, group in itertools.groupby(events, key=lambda e: isinstance(e, tuple)):
            if framed:
                for e in group:
                    self._log.append_frame(*e)
            else:
                self._log.append(list(group))

    def _watch(self, where: dict, pipeline, options) -> ChangeStream:
        if self._log is None:
            self._log = new_log(self.spark, self.path)
        return ChangeStream(self._log, where, pipeline, **options)

    def watch(self, pipeline: list[dict] | None = None, **options: Any) -> ChangeStream:
        return self._watch({"db": self.name}, pipeline, options)


def new_log(spark: SparkSession, path: str | None) -> ChangeLog:
    shared = path or spark.sparkContext.getConf().get("spark.checkpoint.dir") or local_folder(spark)
    return ChangeLog(spark, f"{shared}/_changes/{uuid.uuid4().hex}")


class ClientSession:
    """none → started → in progress → committed or aborted."""

    def __init__(self, db: Database):
        self.db, self.state, self.ended = db, "none", False

    def start_transaction(self) -> None:
        if self.ended:
            raise DocError("the session has ended")
        if self.state == "in progress":
            raise DocError("a transaction is in progress")
        self.db.begin()
        self.state = "in progress"

    def commit_transaction(self) -> None:
        self._in_progress()
        self.db.commit()
        self.state = "committed"

    def abort_transaction(self) -> None:
        self._in_progress()
        self.db.rollback()
        self.state = "aborted"

    def _in_progress(self) -> None:
        if self.state != "in progress":
            raise DocError("no transaction is in progress")

    def in_transaction(self) -> bool:
        return self.state == "in progress"

    def with_transaction(self, work: Callable[[ClientSession], Any]) -> Any:
        self.start_transaction()
        try:
            out = work(self)
        except BaseException:
            if self.in_transaction():
                self.abort_transaction()
            raise
        if self.in_transaction():
            self.commit_transaction()
        return out

    def end_session(self) -> None:
        if self.in_transaction():
            self.abort_transaction()
        self.ended = True

    def __enter__(self) -> ClientSession:
        return self

    def __exit__(self, *_: Any) -> None:
        self.end_session()


class Client:
    """Several named databases; with a path exactly one folder each below it."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, strict: bool = False):
        self.spark, self.path, self.strict = spark, path, strict
        self._databases: dict[str, Database] = {}
        self._log: ChangeLog | None = None

    def watch(self, pipeline: list[dict] | None = None, **options: Any) -> ChangeStream:
        """Events of all databases; those that are watched on their own already keep their logs."""
        self._log = self._log or new_log(self.spark, self.path)
        for db in self._databases.values():
            db._log = db._log or self._log
        return ChangeStream(self._log, {}, pipeline, **options)

    def db(self, name: str = "test") -> Database:
        if name not in self._databases:
            folder = f"{self.path}/{name}" if self.path else None
            self._databases[name] = Database(self.spark, folder, name=name, strict=self.strict)
            self._databases[name]._log = self._log
        return self._databases[name]

    __getitem__ = db

    def list_databases(self) -> list[str]:
        return sorted(self._databases)

    def close(self) -> None:
        self._databases.clear()
