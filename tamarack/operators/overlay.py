"""Merge on read: base tables overlaid with the journal's commits, at any version.

A read takes the newest snapshot at or before its version and the commits behind it. A snapshot holds one row for each id the
journal has touched, in buckets of the id, so that reading a row opens one bucket of the snapshot, the few commits behind it and the
base rows that the scan's filter lets through. Ids nobody has touched come straight from the base table.

A snapshot row says what has become of the base row: ``reset`` (deleted or made anew since), ``alive``, and the values set. It is
read back as at most two mutations, so one fold gives the state after snapshot and commits alike.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.catalog import Catalog
from ..sources.commits import CommitLog, Folder
from . import journal, mutations

BUCKETS = 64
SNAPSHOT = "id string, seq long, reset boolean, alive boolean, values map<string, string>, bucket int"
_SET = "map<string, string>"
_LOG = f"id string, seq struct<at: long, nth: int>, op string, `set` {_SET}"
_INTEGER = re.compile(r"^\s*[+-]?\d+\s*$")
_SNAP = re.compile(r"^s-(\d{16})-([0-9a-f]{32})$")


def bucket_of(id_: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def _steps(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows as mutations (see _LOG): a reset is a delete and, if the row lives, an insert; else what was set is an update."""
    none = F.create_map().cast(_SET)
    step = lambda nth, op, values: F.struct(F.lit(nth).alias("nth"), F.lit(op).alias("op"), values.alias("set"))
    own = F.when(~F.col("reset"), F.array(step(2, "update", F.col("values")))).when(F.col("alive"), F.array(step(0, "delete", none), step(1, "insert", F.col("values")))).otherwise(F.array(step(0, "delete", none)))
    rows = snapshot.select("id", "seq", F.explode(own).alias("s"))
    return rows.select("id", F.struct(F.col("seq").alias("at"), F.col("s.nth").alias("nth")).alias("seq"), F.col("s.op").alias("op"), F.col("s.set").alias("set"))


def folded(log: DataFrame, base_ids: DataFrame) -> DataFrame:
    """(id, seq, reset, alive, values): what ``log`` (see _LOG) makes of each id that it names or that the base holds (``base_ids(id)``); ``seq`` is null where it names none."""
    marker = base_ids.select("id", F.struct(F.lit(0).alias("own"), F.lit(None).cast("struct<at: long, nth: int>").alias("seq")).alias("seq"), F.lit("insert").alias("op"), F.create_map().cast(_SET).alias("set"))
    both = marker.unionByName(log.withColumn("seq", F.struct(F.lit(1).alias("own"), "seq")))
    born = mutations.judged_inserts(both)
    span = born.groupBy("id").agg(F.max(F.when(F.col("valid"), F.col("seq"))).alias("since"), F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"))
    last = log.groupBy("id").agg(F.max("seq.at").alias("seq"))
    alive = F.col("since").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("since")))
    reset = F.col("gone").isNotNull() | (F.col("since.own") == 1)
    span = span.withColumn("alive", alive).withColumn("reset", reset).filter("since is not null or gone is not null")  # an update of a row that never was means nothing
    rows = both.join(span.filter("alive").select("id", "since"), "id").filter((F.col("seq") == F.col("since")) | ((F.col("seq") > F.col("since")) & (F.col("op") == "update")))
    each = rows.select("id", "seq", F.explode("set").alias("key", "value")).groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"))
    values = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
    out = span.join(last, "id", "left").join(values, "id", "left")
    return out.select("id", "seq", "reset", "alive", F.coalesce("values", F.create_map().cast(_SET)).alias("values"))


class Overlay:
    """``catalog`` as it is after the commits of ``log``."""

    def __init__(self, catalog: Catalog, log: CommitLog, buckets: int = BUCKETS) -> None:
        self.catalog, self.log, self.buckets = catalog, log, buckets
        self.snapshots = Folder(catalog.spark, f"{log.folder.path}/_snapshots")
        self.keys = Folder(catalog.spark, f"{log.folder.path}/_keys")
        self._named: dict[str, set[str]] = {}

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    def named(self, after: int, upto: int) -> set[str]:
        """Tables that the commits in (after, upto] write to. What a file names is asked once."""
        files = self.log.files(after, upto)
        fresh = [f for f in files if f not in self._named]
        if fresh:
            rows = self.spark.read.schema(journal.NUMBERED).parquet(*fresh).select(F.regexp_extract(F.input_file_name(), "c-[0-9-]+[.]parquet", 0).alias("file"), "table_name").distinct()
            own: dict[str, set[str]] = {f: set() for f in fresh}
            for file, table in rows.collect():  # a row for each commit and table
                own[f"{self.log.folder.path}/{file}"].add(table)
            self._named.update(own)
        return {t for f in files for t in self._named[f] if t is not None}

    def _snapshot(self, version: int) -> tuple[int, str | None]:
        """(version, folder) of the newest snapshot at or before ``version``."""
        found = [(int(m[1]), f"{self.snapshots.path}/d-{m[2]}") for m in map(_SNAP.match, self.snapshots.names()) if m and int(m[1]) <= version]
        return max(found, default=(0, None))

    def _tables_of(self, snapshot: str | None) -> set[str]:
        return set(Folder(self.spark, snapshot).names()) if snapshot else set()

    def mutations(self, table: str, version: int, only: str | None = None, more: DataFrame | None = None) -> DataFrame | None:
        """Snapshot and commits up to ``version`` as one log of mutations of ``table``, of one id if it is given; None if there are none.
        ``more`` has journal rows (see NUMBERED) that come after them and aren't committed yet."""
        at, snapshot = self._snapshot(version)
        parts = []
        if table in self._tables_of(snapshot):
            rows = self.spark.read.schema(SNAPSHOT).parquet(f"{snapshot}/{table}")
            if only is not None:
                rows = rows.filter((F.col("bucket") == bucket_of(F.lit(only), self.buckets)) & (F.col("id") == only))
            parts.append(_steps(rows))
        logs = [journal.committed(self.spark, self.log, at, version)] if table in self.named(at, version) else []
        for rows in logs + ([] if more is None else [more]):
            if only is not None:
                rows = rows.filter(F.col("row_id") == only)
            parts.append(journal.mutations_of(rows, table, F.col("seq")))
        out = parts[0] if parts else None
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _numbers(self, table: str) -> bool:
        own = self.catalog[table]
        return "id" in own.columns and isinstance(own.schema["id"].dataType, IntegralType)

    def canonical(self, table: str, row_id: object) -> str | None:
        """The text of an id as the table's own type writes it: 05 and 5 are one row where ids are numbers."""
        text = None if row_id is None else str(row_id)
        return str(int(text)) if text is not None and self._numbers(table) and _INTEGER.match(text) else text

    def holds(self, table: str, row_id: str) -> bool:
        """Whether the table's type of ids can hold this one."""
        return not self._numbers(table) or bool(_INTEGER.match(row_id)) and -(1 << 63) <= int(row_id) < 1 << 63

    def table(self, name: str, version: int | None = None, only: str | None = None, more: DataFrame | None = None) -> DataFrame:
        """The table at ``version`` (now, if none is given), and after the rows ``more``; with ``only`` just the row of that id."""
        version = self.log.last() if version is None else version
        base = self.catalog[name]
        if "id" not in base.columns:
            return base
        if only is not None:
            base = base.filter(F.col("id") == F.lit(only).try_cast(base.schema["id"].dataType))
        log = self.mutations(name, version, only, more)
        if log is None:
            return base
        touched = log.select(F.col("id").alias("_touched")).distinct()
        on = F.col("id").cast("string") == F.col("_touched")
        return base.join(touched, on, "left_anti").unionByName(mutations.applied(base.join(touched, on, "left_semi"), log))

    def view(self, version: int, only: dict[str, str] | None = None, more: DataFrame | None = None) -> Catalog:
        """All tables at ``version``, and after the rows ``more``; of the tables in ``only`` just the rows of those ids."""
        return _Lazy(self, version, only or {}, more)

    def index(self, table: str) -> None:
        """Write the ids of a base table in buckets, sorted and with bloom filters, for :meth:`exists`; to be done again when the base table is another."""
        name = f"d-{uuid.uuid4().hex}"
        ids = self.catalog[table].select(F.col("id").cast("string").alias("id")).withColumn("bucket", bucket_of(F.col("id"), self.buckets))
        writer = ids.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket")
        writer.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.keys.path}/{name}")
        places = [int(n.split("-")[1]) for n in self.keys.names() if n.startswith("k-") and n.split("-", 2)[2].startswith(f"{table}.")]
        self.keys.create(f"k-{max(places, default=0) + 1:016d}-{table}.{name}", b"")

    def _ids(self, table: str, row_id: str) -> DataFrame:
        """(id) if the base table holds it: from the index if there is one, else from the table."""
        found = sorted(n for n in self.keys.names() if n.startswith("k-") and n.split("-", 2)[2].startswith(f"{table}."))
        if found:
            ids = self.spark.read.schema("id string, bucket int").parquet(f"{self.keys.path}/{found[-1].rsplit('.', 1)[1]}")
            return ids.filter((F.col("bucket") == bucket_of(F.lit(row_id), self.buckets)) & (F.col("id") == row_id)).select("id")
        base = self.catalog[table]
        return base.filter(F.col("id") == F.lit(row_id).try_cast(base.schema["id"].dataType)).select(F.col("id").cast("string").alias("id"))

    def exists(self, table: str, row_id: str, version: int, more: DataFrame | None = None) -> bool:
        """Whether a row of that id lives at ``version``: one bucket of the index and of the snapshot and the commits behind it are asked."""
        log, ids = self.mutations(table, version, row_id, more), self._ids(table, row_id)
        return bool((ids if log is None else folded(log, ids).filter("alive")).head(1))

    def affected(self, table: str, version: int) -> DataFrame:
        """(op, rows): how many rows of ``table`` the commit ``version`` has made, changed or taken away; what it finds in no row counts nothing.

        The two versions are read at the ids that the commit names alone.
        """
        asked = journal.committed(self.spark, self.log, version - 1, version).filter(F.col("table_name") == table).select(F.col("row_id").alias("_id")).distinct()

        def at(v: int, flag: str) -> DataFrame:
            own = self.table(table, v)
            return own.join(asked, F.col("id").cast("string") == F.col("_id"), "left_semi").select(F.col("id").cast("string").alias("_id"), F.lit(True).alias(flag))

        both = asked.join(at(version - 1, "was"), "_id", "left").join(at(version, "stays"), "_id", "left")
        op = F.when(F.col("was").isNull(), "insert").when(F.col("stays").isNull(), "delete").otherwise("update")
        return both.filter("was or stays").groupBy(op.alias("op")).agg(F.count("*").alias("rows"))

    def compact(self) -> int:
        """Write a snapshot of everything committed so far and roll the commits' files into one; returns the version.

        A snapshot counts once its marker is there, so a compaction that dies, or two at once, change nothing that readers see.
        """
        version = self.log.last()
        at, snapshot = self._snapshot(version)
        if version == at:
            return version
        name = uuid.uuid4().hex
        for table in sorted((self.named(at, version) | self._tables_of(snapshot)) & set(self.catalog.tables)):
            log = self.mutations(table, version)
            base = self.catalog[table].select(F.col("id").cast("string").alias("id"))
            rows = folded(log, base.join(log.select("id").distinct(), "id", "left_semi")).withColumn("bucket", bucket_of(F.col("id"), self.buckets))
            writer = rows.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket")
            writer.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.snapshots.path}/d-{name}/{table}")
        self.snapshots.create(f"s-{version:016d}-{name}", b"")
        ranges = [r for r in self.log.ranges() if r[0] > at and r[1] <= version]
        if len(ranges) > 1:
            first, last, work = ranges[0][0], ranges[-1][1], f"_work-{name}"
            rows = journal.committed(self.spark, self.log, first - 1, last)
            rows.repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(f"{self.log.folder.path}/{work}")
            self.log.roll(first, last, work)
        return version


class _Lazy(Catalog):
    """A catalog whose tables are overlaid when they are asked for."""

    def __init__(self, overlay: Overlay, version: int, only: dict[str, str], more: DataFrame | None) -> None:
        super().__init__(overlay.spark, overlay.catalog.tables)
        self._overlay, self._version, self._only, self._more = overlay, version, only, more

    def __getitem__(self, table: str) -> DataFrame:
        return self._overlay.table(table, self._version, self._only.get(table), self._more)
