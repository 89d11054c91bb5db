"""Hand-written handlers and the interceptor: what one request, or a whole table of them, comes to."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import NamedTuple
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from ..sources.commits import CommitLog
from ..sources.declarations import Declaration, Operation
from . import activity, dedup, journal, mutations, reads, routing
from .overlay import Overlay
from .params import merged
from .routing import Resolved, resolve, resolve_operation

Handler = Callable[[SparkSession, dict], DataFrame]


class Registry:
    """Handlers by name; a name twice or unknown is an error. An offline handler works on local tables, an online one calls the network; ``metadata`` makes a write's metadata itself."""

    def __init__(self) -> None:
        self._own: dict[str, tuple[Handler, str, Callable[[dict], str] | None]] = {}

    def add(self, name: str, handler: Handler, connectivity: str = "offline", metadata: Callable[[dict], str] | None = None) -> None:
        if name in self._own:
            raise ValueError(f"{name} is registered already")
        self._own[name] = (handler, connectivity, metadata)

    def get(self, name: str, connectivity: str | None = None) -> Handler:
        if name not in self._own:
            raise KeyError(f"no handler {name}; there are: {', '.join(self._own) or 'none'}")
        handler, own, _ = self._own[name]
        if connectivity is not None and own != connectivity:
            raise ValueError(f"{name} is an {own} handler, the operation is {connectivity}")
        return handler

    def metadata(self, name: str) -> Callable[[dict], str] | None:
        return self._own[name][2]


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@dataclass
class Engine:
    """Operations first, then composed entity requests; anything else is passed through (None).

    ``log`` is the journal's folder, without which nothing can be written. Every read sees what was committed before it
    (:class:`~tamarack.operators.overlay.Overlay`); an answer stays that of its version, whenever it is read. Equal requests inside the window get the answer of
    the one that ran, failures and passed-through requests are never remembered. ``events`` holds the latest activity rows, the oldest going first.
    """

    catalog: Catalog
    declaration: Declaration
    operations: list[Operation]
    handlers: Registry
    log: str | None = None
    guard: dedup.Guard = field(default_factory=dedup.Guard)
    new_id: Callable[[], str] = field(default=lambda: str(uuid.uuid4()))
    now: Callable[[], str] = _now
    clock_ms: Callable[[], int] = field(default=lambda: time.time_ns() // 1_000_000)
    events: list[tuple] = field(default_factory=list)
    _overlay: Overlay | None = None
    _open: list[tuple] | None = None

    @property
    def overlay(self) -> Overlay:
        """The tables with the journal's commits on them."""
        if self.log is None:
            raise mutations.MutationError("writes go through the journal: the engine has no folder for it")
        if self._overlay is None:
            self._overlay = Overlay(self.catalog, CommitLog(self.catalog.spark, self.log))
        return self._overlay

    def _more(self, version: int) -> DataFrame | None:
        """The rows of the open transaction as they would follow ``version``."""
        if not self._open:
            return None
        rows = [(*r, ((version + 1) << journal.PLACES) + i) for i, r in enumerate(self._open)]
        return self.catalog.spark.createDataFrame(rows, journal.NUMBERED)

    def view(self, only: dict[str, str] | None = None) -> Catalog:
        """The catalog as it is now: base tables, commits and the open transaction's writes."""
        if self.log is None:
            return self.catalog
        version = self.overlay.log.last()
        return self.overlay.view(version, only, self._more(version))

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        """The writes inside are one commit: all of them, or none if anything raises. Reads inside see them."""
        if self._open is not None:
            raise mutations.MutationError("a transaction is open already")
        self._open, events, guard = [], list(self.events), self.guard.copy()
        try:
            yield self
            if self._open:
                self._commit(self._open)
        except BaseException:
            self.events[:], self.guard = events, guard
            raise
        finally:
            self._open = None

    def _commit(self, rows: list[tuple]) -> int:
        """One commit of journal rows; an insert whose id is there by then, also by another writer's commit, refuses them all."""
        overlay = self.overlay

        def check(version: int) -> None:
            for i, (_, _, _, _, _, table, row_id, steps) in enumerate(rows):
                if steps[-1][0] == "insert":
                    before = [(*r, ((version + 1) << journal.PLACES) + k) for k, r in enumerate(rows[:i]) if r[5] == table and r[6] == row_id]
                    more = overlay.spark.createDataFrame(before, journal.NUMBERED) if before else None
                    if overlay.exists(table, row_id, version, more):
                        raise mutations.MutationError(f"{table} has a row {row_id!r} already")

        return overlay.log.append(lambda number: journal.commit_bytes(rows, number), check)

    def compact(self) -> int:
        """Fold the commits so far into a snapshot; nothing that can be read changes."""
        return self.overlay.compact()

    def handles(self, method: str, url: str) -> bool:
        return resolve_operation(self.operations, method, url) is not None or resolve(self.declaration, method, url) is not None

    def run(self, method: str, url: str, body: dict | None = None) -> DataFrame | None:
        op, path = resolve_operation(self.operations, method, url) or (None, {})
        entity = None if op else resolve(self.declaration, method, url)
        if op is None and entity is None:
            return None
        key, at = dedup.fingerprint_of(method, url, body), self.clock_ms()
        known = self.guard.find(key, at, op.dedup_window_ms if op else None)
        if known is not None:
            return known
        if op:
            context = merged(path, url, body)
            handler = self.handlers.get(op.handle, op.connectivity)
            if op.connectivity == "offline":
                own = self.handlers.metadata(op.handle)
                context["_metadata"] = own(context) if own else metadata_of(method, url, op.operation_id, body)
            answer = handler(self.catalog.spark, context)
            kind = "local-write" if op.connectivity == "offline" else "request-handled"
            self._record(kind, operation=op.operation_id, method=method.upper())
        elif mutations.kind_of(method) == "read":
            answer = reads.read(self.view(self._one(entity)), entity)[0]
            self._record("request-handled", table=entity.table, method=method.upper(), url=url)
        else:
            answer = self.write(entity, method, url, body)
            self._record("local-write", table=entity.table, method=method.upper(), url=url)
        self.guard.remember(key, answer, at)
        return answer

    def _record(self, kind: str, **detail: str) -> None:
        self.events.append(activity.event(kind, self.now(), **detail))
        del self.events[: -activity.KEPT]

    def _one(self, entity: Resolved) -> dict[str, str] | None:
        """{table: id} where a read wants one row and its table comes in no other role."""
        own, route = reads.id_hole(entity), entity.route
        twice = route is not None and (any(a.table == entity.table for a in route.aggregates) or any(entity.table in j for j in route.joins))
        if own is None or twice or self.log is None:
            return None
        return {entity.table: self.overlay.canonical(entity.table, entity.params[own])}

    def tenant(self, table: str) -> str | None:
        """The tenant of local rows: the table's own, else that of the first other table that has one."""
        own = [t for t in [table, *(n for n in self.catalog.tables if n != table)] if "tenant_id" in self.catalog.columns(t)]
        if table not in own:
            return None
        now = self.view()
        rows = [now[t] for t in own]
        return mutations.first_tenant(rows[0], rows[1:]).first()["tenant"]

    def write(self, entity: Resolved, method: str, url: str, body: dict | None = None) -> DataFrame:
        """One commit of request and steps, or a part of the open transaction's; the answer is the row as written, for a delete the row that goes.

        An insert of an id that is there raises and leaves nothing, neither a row nor a request to replay.
        """
        overlay = self.overlay
        row, columns = self.compose(entity, method, url, body)
        table, row_id, steps = row[5:]
        op, values = steps[-1]
        version = overlay.log.last()
        gone = overlay.table(table, version, row_id, self._more(version)) if op == "delete" else None
        if self._open is None:
            version = self._commit([row])
        else:
            if op == "insert" and overlay.exists(table, row_id, version, self._more(version)):
                raise mutations.MutationError(f"{table} has a row {row_id!r} already")
            self._open.append(row)
        if op == "insert":
            return self.catalog.spark.createDataFrame([tuple(values.get(c) for c in columns)], ", ".join(f"{c} string" for c in columns))
        return gone if op == "delete" else overlay.table(table, version, row_id, self._more(version))

    def compose(self, entity: Resolved, method: str, url: str, body: dict | None) -> tuple[tuple, list[str]]:
        """The journal row of a write and the columns of its table."""
        request, now = self.new_id(), self.now()
        columns = self.catalog.columns(entity.table)
        hole = reads.id_hole(entity)
        row_id = self.overlay.canonical(entity.table, entity.params.get(hole)) if hole else None
        kind = mutations.kind_of(method)
        if kind == "insert":
            given = {c: entity.params[h] for c, h in reads.filters_of(entity, columns).items()}
            values = mutations.insert(columns, body, given, entity.route.defaults if entity.route else {}, self.new_id(), now, self.tenant(entity.table), request)
            row_id = self.overlay.canonical(entity.table, values["id"])
            if not self.overlay.holds(entity.table, row_id):
                raise mutations.MutationError(f"{values['id']!r} is no id of {entity.table}")
            steps = [("insert", {**values, "id": row_id})]
        elif kind == "update":
            steps = [("update", mutations.update(columns, body, row_id, now, request))]
        else:
            steps = mutations.delete(columns, row_id, request)
        parts = urlsplit(url)
        path = parts.path + (f"?{parts.query}" if parts.query else "")
        return journal.entry(request, method, path, body, now, entity.table, row_id, steps), columns


class Written(NamedTuple):
    """What a write answers: its rows and how many there are; none of either for a request that nobody handles."""

    rows: list[dict]
    rows_affected: int


def written(answer: DataFrame | None) -> Written:
    """The answer of a write read once; an update or delete of a row that isn't there affects none."""
    rows = [] if answer is None else [r.asDict(recursive=True) for r in answer.collect()]
    return Written(rows, len(rows))


def metadata_of(method: str, url: str, operation: str, body: object = None) -> str:
    """A write's metadata: method, path with its query string, operation and body, if there is one."""
    import json

    parts = urlsplit(url)
    out = {"method": method.upper(), "path": parts.path + (f"?{parts.query}" if parts.query else ""), "operationId": operation}
    return json.dumps(out if body is None else {**out, "body": body})


def handled(requests: DataFrame, operations: Sequence[Operation], routes: Sequence[tuple[str, str, str]], prefixes: Mapping[str, str]) -> DataFrame:
    """``requests`` (method, path) with ``handles``: whether an operation or a table answers them, or they go to the server."""
    ops = routing.match_batch(requests, [(o.method, o.path, o.operation_id) for o in operations], decode=True)
    ops = ops.withColumn("_op", F.col("status") == routing.MATCHED).drop("status", "target", "route_path", "params")
    both = routing.match_batch(ops, routes).withColumn("_route", F.col("status") == routing.MATCHED).drop("status", "target", "route_path", "params")
    under = F.lit(False)
    if prefixes:
        both = routing.prefix_batch(both, prefixes)
        under = F.col("table").isNotNull()
        both = both.withColumn("_under", under).drop("table", "prefix", "id", "collection")
    else:
        both = both.withColumn("_under", under)
    return both.withColumn("handles", F.col("_op") | F.col("_route") | F.col("_under")).drop("_op", "_route", "_under")


def intercept(requests: DataFrame, operations: Sequence[Operation], routes: Sequence[tuple[str, str, str]], prefixes: Mapping[str, str], window_ms: int = dedup.WINDOW_MS) -> DataFrame:
    """A table of requests (seq, at, method, path, body), each judged as :meth:`Engine.run` would: with (source, target, by, activity).

    ``source`` is operation, entity or server; ``by`` is the seq of the request whose answer it gets (its own if it runs, null
    if it goes to the server); ``activity`` is the kind of row that a request which runs leaves.
    Each (method, path) is judged once, and every request gets its judgement by a join.
    """
    asked = requests.select("method", "path").distinct()
    ops = routing.match_batch(asked, [(o.method, o.path, o.operation_id) for o in operations], decode=True).withColumnRenamed("target", "_op").drop("status", "route_path", "params")
    both = routing.match_batch(ops, routes).withColumnRenamed("target", "_route").drop("status", "route_path", "params")
    both = routing.prefix_batch(both, prefixes) if prefixes else both.withColumn("table", F.lit(None).cast("string"))
    known = F.upper("method").isin("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE")
    entity = F.coalesce("_route", F.when(known, F.col("table")))
    judged = both.withColumn("source", F.when(F.col("_op").isNotNull(), "operation").when(entity.isNotNull(), "entity").otherwise("server")).withColumn("target", F.coalesce("_op", entity))
    window = F.lit(window_ms)
    read = F.upper("method").isin("GET", "HEAD")
    kind = F.when(F.col("source") == "entity", F.when(read, "request-handled").otherwise("local-write"))
    for o in operations:
        if o.dedup_window_ms is not None:
            window = F.when(F.col("_op") == o.operation_id, o.dedup_window_ms).otherwise(window)
        kind = F.when(F.col("_op") == o.operation_id, "local-write" if o.connectivity == "offline" else "request-handled").otherwise(kind)
    judged = judged.select(F.col("method").alias("_m"), F.col("path").alias("_p"), "source", "target", kind.alias("activity"), (window.cast("long") * 1000).alias("_window"))
    # every request has a judgement; a left join, so that only the judgements are ever broadcast
    out = requests.join(judged, requests["method"].eqNullSafe(F.col("_m")) & requests["path"].eqNullSafe(F.col("_p")), "left")
    names = [*requests.columns, "source", "target", "activity"]
    mine = out.filter(~F.col("source").eqNullSafe("server")).withColumn("_body", dedup.canonical(F.col("body"))).withColumn("_print", dedup.digest(F.col("method"), F.col("path"), F.col("_body")))
    mine = dedup.answered(mine.select(*names, F.col("_window").alias("_w"), "_print"), ["_print"], "at", "seq", F.col("_w")).select(*names, "by")
    mine = mine.withColumn("activity", F.when(F.col("by") == F.col("seq"), F.col("activity")))
    return mine.unionByName(out.filter(F.col("source").eqNullSafe("server")).select(*names, F.lit(None).cast("long").alias("by")))
