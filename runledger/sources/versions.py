"""Versions of one or several Parquet tables under one manifest.

A manifest is a small JSON file that names, per table, the folders that hold it. A
new version is written to new folders first and becomes visible by one rename of
its manifest into ``_manifests/``; a rename that finds the name taken fails, so of
two writers one is told. A reader opens the folders of one manifest and nothing
else: it never sees half of a write, a write that is repeated, or one table of a
version with another table of the next. Folders that stay in a version are not
rewritten and keep their names.

A table is a list of parts. What a part stands for is its writer's: a bucket of
keys that is replaced as a whole, or a run of changes in the order of its writing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .folders import folder_names, place_of

MANIFESTS = "_manifests"
#: The column that deals rows to parts; it is a folder name and not stored in the files.
PART = "__part"


class VersionTaken(RuntimeError):
    """Another writer has committed the version that this one was to become."""


@dataclass(frozen=True)
class Part:
    """A folder below the base, the bucket it holds, if any, and its number of rows."""

    folder: str
    rows: int
    bucket: int | None = None


@dataclass(frozen=True)
class Table:
    schema: str
    parts: tuple[Part, ...] = ()
    buckets: int | None = None
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Version:
    """What one manifest says; number 0 is a base without a manifest."""

    base: str
    number: int = 0
    tables: Mapping[str, Table] = field(default_factory=dict)
    marks: Mapping[str, int] = field(default_factory=dict)

    def read(self, spark: SparkSession, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of this version, or only some of its buckets: other folders are not listed."""
        table = self.tables[name]
        wanted = None if buckets is None else set(buckets)
        folders = [f"{self.base}/{p.folder}" for p in table.parts if wanted is None or p.bucket in wanted]
        schema = StructType.fromJson(json.loads(table.schema))
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def to_json(self) -> str:
        tables = {
            name: {
                "schema": json.loads(t.schema), "buckets": t.buckets, "keys": list(t.keys),
                "parts": [{"folder": p.folder, "rows": p.rows, "bucket": p.bucket} for p in t.parts],
            }
            for name, t in self.tables.items()
        }
        return json.dumps({"version": self.number, "marks": dict(self.marks), "tables": tables})


def _from_json(base: str, text: str) -> Version:
    said = json.loads(text)
    tables = {
        name: Table(json.dumps(t["schema"]), tuple(Part(**p) for p in t["parts"]), t["buckets"], tuple(t["keys"]))
        for name, t in said["tables"].items()
    }
    return Version(base, said["version"], tables, said["marks"])


def committed(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions that can be read, ascending."""
    place, system = place_of(spark, f"{base.rstrip('/')}/{MANIFESTS}")
    found = system.listStatus(place) if system.exists(place) else []
    names = [s.getPath().getName() for s in found]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def open_version(spark: SparkSession, base: str, number: int | None = None) -> Version:
    """The newest version, or a given one."""
    base = base.rstrip("/")
    if number is None:
        number = max(committed(spark, base), default=0)
    if number == 0:
        return Version(base)
    place, system = place_of(spark, f"{base}/{MANIFESTS}/{number:010d}.json")
    stream = system.open(place)
    try:
        return _from_json(base, spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(
    spark: SparkSession, seen: Version, tables: Mapping[str, Table], marks: Mapping[str, int] | None = None
) -> Version:
    """Make the version after ``seen``, with the given tables in place of those of their names.

    The manifest is written beside its place and renamed into it. ``VersionTaken`` if
    another writer was first: what this one read is no longer the newest.
    """
    new = Version(seen.base, seen.number + 1, {**seen.tables, **tables}, {**seen.marks, **(marks or {})})
    jvm = spark.sparkContext._jvm
    draft, system = place_of(spark, f"{new.base}/{MANIFESTS}/.{uuid.uuid4().hex}")
    target, _ = place_of(spark, f"{new.base}/{MANIFESTS}/{new.number:010d}.json")
    stream = system.create(draft, False)
    try:
        stream.write(new.to_json().encode())
    finally:
        stream.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(draft).toUri(), conf)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE  # never over a manifest that is there
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), how)
    except Py4JJavaError as exc:
        system.delete(draft, False)
        if "AlreadyExists" in exc.java_exception.getClass().getSimpleName():
            raise VersionTaken(f"version {new.number} of {new.base} is there already") from None
        raise
    return new


def schema_text(df: DataFrame) -> str:
    return json.dumps(json.loads(df.schema.json()))


def bucket_of(keys: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, base: str, name: str, keys: Iterable[str], buckets: int) -> Table:
    """Write rows dealt to buckets by their keys; not visible before a commit names them.

    Rows of a bucket meet in few files, and a bucket that holds much more than
    others is spread over several tasks and files.
    """
    keys = tuple(keys)
    spark, folder = df.sparkSession, f"{name}/{uuid.uuid4().hex}"
    dealt = df.withColumn(PART, bucket_of(keys, buckets)).hint("rebalance", PART)
    dealt.write.partitionBy(PART).parquet(f"{base.rstrip('/')}/{folder}")
    found = sorted(int(n.removeprefix(f"{PART}=")) for n in folder_names(spark, f"{base}/{folder}") if n.startswith(PART))
    counts = dict(spark.read.parquet(f"{base}/{folder}").groupBy(PART).count().collect()) if found else {}
    parts = tuple(Part(f"{folder}/{PART}={b}", counts[b], b) for b in found)
    return Table(schema_text(df), parts, buckets, keys)


def write_whole(df: DataFrame, base: str, name: str) -> Table:
    """Write a small table as one part; not visible before a commit names it."""
    folder = f"{name}/{uuid.uuid4().hex}"
    df.write.parquet(f"{base.rstrip('/')}/{folder}")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{base.rstrip('/')}/{folder}").count()
    return Table(schema_text(df), (Part(folder, rows),))


def replaced(old: Table, new: Table, buckets: Iterable[int]) -> Table:
    """``old`` with the given buckets taken from ``new``; the folders of all others stay."""
    gone = set(buckets)
    return Table(old.schema, tuple(p for p in old.parts if p.bucket not in gone) + new.parts, old.buckets, old.keys)


def _top(folder: str) -> str:
    """The folder of one write, which may hold several parts."""
    return folder.split(f"/{PART}=")[0]


def unused_folders(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Folders of tables that none of the last ``keep`` versions names: of old versions and lost writes."""
    versions = [open_version(spark, base, n) for n in committed(spark, base)[-keep:]]
    named = {_top(p.folder) for v in versions for t in v.tables.values() for p in t.parts}
    tables = sorted({name for v in versions for name in v.tables})
    return [f"{t}/{f}" for t in tables for f in folder_names(spark, f"{base}/{t}") if f"{t}/{f}" not in named]


def expire(spark: SparkSession, base: str, keep: int) -> list[str]:
    """Remove what only versions before the last ``keep`` need, their manifests first.

    For the one writer of a base, between its writes: a reader that still has an
    older version open loses its files, and a write under way by someone else too.
    """
    base = base.rstrip("/")
    for number in committed(spark, base)[:-keep]:
        place, system = place_of(spark, f"{base}/{MANIFESTS}/{number:010d}.json")
        system.delete(place, False)
    gone = unused_folders(spark, base, keep)
    for folder in gone:
        place, system = place_of(spark, f"{base}/{folder}")
        system.delete(place, True)
    return gone
