"""Files listed and read inside tasks: names, times, and bytes from the end of a file.

Spark's readers open a file from its front and leave empty files out; these open
what a task needs. A task finds a file's system by its address; a store that pyarrow
does not know is given by the caller, as a function from an address to a file system
and a path in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .folders import place_of

Resolve = Callable[[str], tuple[fs.FileSystem, str]]

#: Read at once from the end of a file; what follows doubles, up to the largest.
BLOCK_BYTES = 1 << 16
LARGEST_BLOCK = 1 << 24

LISTED = "path string, is_folder boolean, length bigint, written_at timestamp"
BREAK = re.compile(rb"\r\n|\r|\n")
#: What Java leaves as it is in the path of an address; other ASCII is escaped.
PLAIN = re.compile(r"[^A-Za-z0-9/_.!~'();:@&=+$,*\-\u0080-\U0010ffff]")


def resolve(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    address = re.sub("^file:/+", "file:///", re.sub("[^\x00-\x7f]", lambda c: quote(c[0]), address))
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", address))


def address(spark: SparkSession, path: str) -> str:
    """The full address of a path of the session's file systems."""
    place, system = place_of(spark, path)
    return re.sub("^file:/+", "file:/", system.makeQualified(place).toUri().toString())


def plain_name(name: Column) -> Column:
    """A folder name as it was given: once decoded as an address, once as Hive escapes it."""
    decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    once = decode(name)
    return F.coalesce(F.when(once.contains("%"), F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B")))), once)


def _entries(folder: str, deep: bool, found: Resolve) -> Iterator[tuple]:
    system, path = found(folder)
    path = path.rstrip("/")
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=deep)):
        below = info.path[len(path) :].strip("/")
        is_folder = info.type == fs.FileType.Directory
        if not (deep and is_folder):
            name = PLAIN.sub(lambda c: quote(c[0], safe=""), below)
            yield f"{folder.rstrip('/')}/{name}", is_folder, info.size, info.mtime


def entries(folders: DataFrame, deep: bool, found: Resolve = resolve) -> DataFrame:
    """What lies in each of ``folders`` (path): its files and folders, or, ``deep``, all files below it.

    Folders are listed by tasks, each task its own; a folder that is not there holds nothing.
    """
    kind = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()), ("written_at", pa.timestamp("us", "UTC"))])

    def listed(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for row in _entries(folder, deep, found):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    return folders.select("path").mapInArrow(listed, LISTED)


def files_of(spark: SparkSession, folders: list[str], found: Resolve = resolve) -> DataFrame:
    """All files below the given folders, at any depth, empty ones included.

    The driver makes one address per folder given and lists nothing. Tasks list the
    folders, then the folders in them, and what lies deeper in a third stage with
    each of those folders a row of its own, so that no task holds a large tree alone.
    """
    level = spark.createDataFrame([(address(spark, f),) for f in folders], "path string")
    files = None
    for deep in (False, False, True):
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        seen = entries(level.repartition(parts), deep, found)
        mine = seen.where(~F.col("is_folder")).drop("is_folder")
        files = mine if files is None else files.unionByName(mine)
        level = seen.where("is_folder").select("path")
    return files


def tail_of(file, n: int, block: int = BLOCK_BYTES) -> tuple[list[bytes], int]:
    """The last ``n`` lines of an open file and the number of bytes read for them.

    Blocks are read from the end backwards until they hold ``n`` whole lines. Lines
    end as Spark's text reader ends them: at a line feed, a carriage return or both.
    """
    size = file.size()
    at, held, ends = size, [], 0
    while at and ends <= n:
        start = max(0, at - block)
        file.seek(start)
        held.append(file.read(at - start))
        # A pair of carriage return and line feed may be cut by a block: then it counts twice, and a line more is read.
        ends += len(BREAK.findall(held[-1])) - sum(piece.startswith(b"\n") for piece in held[-2:-1])
        at, block = start, min(2 * block, LARGEST_BLOCK)
    text = b"".join(reversed(held))
    lines = BREAK.split(text)
    if lines and not lines[-1]:
        lines.pop()  # a trailing break adds no line
    return lines[-n:] if n else [], size - at


def tails(files: DataFrame, n: int, path: str = "path", found: Resolve = resolve, block: int = BLOCK_BYTES) -> DataFrame:
    """``files`` with ``line_no, line`` of their last ``n`` lines and ``bytes_read``; a file without lines gives no row.

    Lines are numbered from 1 in file order among those kept. Only the ends of files
    are read; files are dealt over all tasks.
    """
    kept = [c for c in files.columns if c not in ("line_no", "line", "bytes_read")]

    def read(batches):
        for batch in batches:
            for i, where in enumerate(batch.column(path).to_pylist()):
                system, inner = found(where)
                with system.open_input_file(inner) as file:
                    lines, n_bytes = tail_of(file, n, block)
                if lines:
                    own = batch.slice(i, 1).take(pa.array([0] * len(lines)))
                    text = [line.decode("utf-8", "replace") for line in lines]
                    new = [pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(text), pa.array([n_bytes] * len(lines), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*kept, "line_no", "line", "bytes_read"])

    schema = files.select(kept).schema.add("line_no", "long").add("line", "string").add("bytes_read", "long")
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select(kept).repartition(parts).mapInArrow(read, schema)
