"""Files of logs and databases, read as streams inside tasks where Spark's own readers would hold a whole file in one cell.

A large text file is read by many tasks, each taking the lines that begin in its range of bytes; an archive or a
database is read by one. A file that cannot be read loses only itself, and damages() tells which and why. An archive
that is broken, cut short or decodes to more than MOST_DECODED contributes nothing, as no part of it can be trusted.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import share_package

#: Columns of a file's lines: place is the byte where a line begins, or a row's number.
LINES = "path string, modified_ms bigint, place bigint, line string"
#: Bytes of a text file that one task reads, and of a block.
RANGE, BLOCK = 64 << 20, 1 << 20
#: Lines or rows of one batch.
BATCH = 10_000
#: Most bytes of an unpacked archive, and of a packed column. Fixed values of the formats' own readers.
MOST_DECODED, MOST_UNPACKED = 1 << 30, 32 << 20
#: File systems that tasks open themselves, and other names of them; files of any other come through Spark's binary reader.
SYSTEMS = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def opened(path: str) -> Any:
    """A seekable file of a path as Spark spells it; an OSError where it cannot be opened."""
    from pyarrow import fs

    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    authority, _, inside = rest.removeprefix("//").partition("/")
    try:
        system, base = fs.FileSystem.from_uri(f"{SYSTEMS.get(scheme, scheme)}://{authority}/")
    except (ValueError, NotImplementedError) as unknown:
        raise OSError(f"no reader for {scheme}") from unknown
    return system.open_input_file(f"{base.rstrip('/')}/{inside}")


def _near(spark: SparkSession, root: str) -> bool:
    """Whether tasks can open files of this root's file system themselves."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() in SYSTEMS


def listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, size, modified_ms and content of files; content is null where tasks open them themselves. Dealt out by path, as a listing is one small partition."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    content = F.lit(None).cast("binary") if _near(spark, root) else F.col("content")
    return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), content.alias("content"))


def _dealt(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _file(path: str, content: bytes | None) -> Any:
    return io.BytesIO(content) if content is not None else opened(path)


def batch_of(path: str, changed_ms: int, places: Any, lines: list[str], damage: str | None = None) -> pa.RecordBatch:
    n = len(lines)
    columns = {"path": pa.array([path] * n, pa.string()), "modified_ms": pa.array([changed_ms] * n, pa.int64()), "place": pa.array(places, pa.int64()), "line": pa.array(lines, pa.string()), "damage": pa.array([damage] * n, pa.string())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def lines_between(file: Any, first: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin from first on and before end, and where each begins; ranges that meet lose and repeat none."""
    source = io.BufferedReader(file, BLOCK) if not isinstance(file, io.BytesIO) else file
    at = first
    if first:
        source.seek(first - 1)
        at = first - 1 + len(source.readline())
    else:
        source.seek(0)
    while at < end and (line := source.readline()):
        yield at, line
        at += len(line)


def _decoder(file: Any) -> Any:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)


def archive_damage(file: Any, most: int = MOST_DECODED) -> str | None:
    """What is wrong with a zstandard archive, if anything: it is decoded once for that, in blocks."""
    import zstandard

    try:
        decoded, last = 0, b""
        stream = _decoder(file)
        while block := stream.read(BLOCK):
            decoded, last = decoded + len(block), block
            if decoded > most:
                return f"decodes to more than {most} bytes"
    except zstandard.ZstdError as broken:
        return str(broken)
    # a stream that ends within a frame gives what it has without an error; a whole one ends its last frame
    return None if _ends_whole(file) else "cut short"


def _ends_whole(file: Any) -> bool:
    """Whether the last frame of an archive is whole: its parts are fed to a decoder that tells when a frame ends."""
    import zstandard

    file.seek(0)
    decoder = zstandard.ZstdDecompressor().decompressobj()
    started = False
    while block := file.read(BLOCK):
        while block:
            started = True
            for _ in (decoder.decompress(block),):
                pass
            if not decoder.eof:
                break
            block, started = decoder.unused_data, False
            decoder = zstandard.ZstdDecompressor().decompressobj()
    return not started


def _text(spark: SparkSession, root: str, glob: str, size: int) -> DataFrame:
    """LINES and damage: null for lines, and a row without a line for each file that cannot be read."""
    share_package(spark)
    files = listed(spark, root, glob)
    whole = F.col("path").endswith(".zst") | F.col("content").isNotNull()
    step = F.when(whole, F.greatest("size", F.lit(1))).otherwise(F.lit(size)).cast("long")
    ranges = files.select("path", "modified_ms", "content", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), step)).alias("first"), step.alias("step"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, changed_ms, content, length, first, step_ in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with _file(path, content) as file:
                        if path.endswith(".zst"):
                            if wrong := archive_damage(file):
                                yield batch_of(path, changed_ms, [None], [None], wrong)
                                continue
                            file.seek(0)
                            found = _numbered(io.BufferedReader(_decoder(file), BLOCK))
                        else:
                            found = lines_between(file, first, min(first + step_, length))
                        places, lines = [], []
                        for at, line in found:
                            places.append(at)
                            lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                            if len(lines) == BATCH:
                                yield batch_of(path, changed_ms, places, lines)
                                places, lines = [], []
                        yield batch_of(path, changed_ms, places, lines)
                except OSError as wrong:
                    yield batch_of(path, changed_ms, [None], [None], str(wrong))

    return _dealt(ranges, "path", "first").mapInArrow(read, f"{LINES}, damage string")


def _numbered(stream: Any) -> Iterator[tuple[int, bytes]]:
    at = 0
    while line := stream.readline():
        yield at, line
        at += len(line)


def lossy_lines(spark: SparkSession, root: str, glob: str, size: int = RANGE) -> DataFrame:
    """path, place, line and time of change of text files, also of zstandard archives; bytes that are no UTF-8 become replacement characters, so one bad byte loses no line."""
    return _text(spark, root, glob, size).where("damage is null").drop("damage")


def _unpacked(kind: str | None, body: bytes | str | None) -> str | None:
    """Text of a database's column that is plain or packed with zstandard; null if it is neither or too long."""
    import zstandard

    raw = body.encode() if isinstance(body, str) else body or b""
    try:
        if (kind or "").strip().lower() == "zstd":
            raw = _decoder(io.BytesIO(raw)).read(MOST_UNPACKED + 1)
        elif (kind or "").strip().lower() != "json":
            return None
    except zstandard.ZstdError:
        return None
    return raw.decode("utf-8", "replace") if len(raw) <= MOST_UNPACKED else None


def _copied(path: str, content: bytes | None, to: str) -> bool:
    """A file's bytes written to a local one, in blocks; False where there is none."""
    try:
        with _file(path, content) as file, open(to, "wb") as out:
            while block := file.read(BLOCK):
                out.write(block)
    except FileNotFoundError:
        return False
    return True


def _database(spark: SparkSession, root: str, glob: str, statements: list[str], functions: dict[str, tuple[int, Callable]]) -> DataFrame:
    """As _text, of the rows of a statement over each database."""
    share_package(spark)
    files = listed(spark, root, glob)
    near = _near(spark, root)
    logs = listed(spark, root, f"{glob}-wal").select(F.expr("left(path, length(path) - 4)").alias("path"), F.col("content").alias("wal"))
    source = files.select("path", "modified_ms", "content", F.lit(None).cast("binary").alias("wal")) if near else files.join(logs, "path", "left").select("path", "modified_ms", "content", "wal")

    def rows(base: sqlite3.Connection, path: str, changed_ms: int) -> Iterator[pa.RecordBatch]:
        for asked in statements:
            at = 0
            try:
                cursor = base.execute(asked)
            except sqlite3.OperationalError as wrong:
                if re.search("no such (table|column|function)", str(wrong)):
                    continue  # another schema
                raise
            while found := cursor.fetchmany(BATCH):
                yield batch_of(path, changed_ms, range(at, at + len(found)), [json.dumps(dict(r), default=lambda b: b.decode("utf-8", "replace")) for r in found])
                at += len(found)
            if at:
                return

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, changed_ms, content, wal in zip(*(c.to_pylist() for c in batch.columns)):
                # a copy in the task's own scratch folder: a database in write-ahead mode can only be opened beside its log, and writes there
                with tempfile.TemporaryDirectory() as scratch:
                    try:
                        if not _copied(path, content, f"{scratch}/base"):
                            continue
                        if content is None or wal is not None:
                            _copied(f"{path}-wal", wal, f"{scratch}/base-wal")
                        base = sqlite3.connect(f"{scratch}/base")
                        base.row_factory = sqlite3.Row
                        base.text_factory = lambda raw: raw.decode("utf-8", "replace")
                        for name, (n, function) in {"unpacked": (2, _unpacked), **functions}.items():
                            base.create_function(name, n, function)
                        try:
                            yield from rows(base, path, changed_ms)
                        finally:
                            base.close()
                    except (OSError, sqlite3.DatabaseError) as wrong:
                        yield batch_of(path, changed_ms, [None], [None], str(wrong))

    return _dealt(source, "path").mapInArrow(read, f"{LINES}, damage string")


def sqlite_rows(spark: SparkSession, root: str, glob: str, statement: str | list[str], functions: dict[str, tuple[int, Callable]] | None = None) -> DataFrame:
    """path, place, time of change and, as a JSON object, each row of a statement over each database file; of several, the first that gives rows there.

    functions: names of Python functions that statements may call, with the number of their arguments. A task reads
    one database at a time, from a copy in its scratch folder, with the write-ahead log beside it.
    """
    return _database(spark, root, glob, [statement] if isinstance(statement, str) else statement, functions or {}).where("damage is null").drop("damage")


def damages(spark: SparkSession, root: str, glob: str, statement: str | list[str] | None = None) -> DataFrame:
    """path and damage of each file that cannot be read: of text files and archives, or of databases where a statement is given. A schema that the statement does not fit is no damage."""
    found = _text(spark, root, glob, RANGE) if statement is None else _database(spark, root, glob, [statement] if isinstance(statement, str) else statement, {})
    return found.where("damage is not null").select("path", "damage").distinct()
