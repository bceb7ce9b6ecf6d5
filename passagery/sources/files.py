"""Raw file sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagery import constants as K
from passagery.functions import text as T

BATCH_BYTES, BATCH_FILES = 8 << 20, 1024
#: names that Spark's readers leave out as well
HIDDEN = ("_", ".")


@lru_cache(maxsize=64)
def _opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a folder and its path there; a name without a scheme or with `file:` is a local one."""
    if path.startswith("file:") or "://" not in path:
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


def _places(spark: SparkSession, path: str) -> list[tuple[str, int | None]]:
    """Folders that `path` names, and files with their lengths if it names such; none for a pattern that nothing matches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if found is None:
        raise FileNotFoundError(path)
    return [(s.getPath().toString(), None if s.isDirectory() else s.getLen()) for s in found]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, length) of the files directly inside the folders of the batches."""
    rows = lambda files: pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*files), (pa.string(), pa.int64()))], names=["path", "length"])
    for batch in batches:
        for place, length in zip(*(c.to_pylist() for c in batch.columns)):
            if length is not None:
                yield rows([(place, length)])
                continue
            system, folder = _opened(place)
            files = [(f"{place}/{f.base_name}", f.size) for f in system.get_file_info(FileSelector(folder)) if f.type == FileType.File and not f.base_name.startswith(HIDDEN)]
            for start in range(0, len(files), 1 << 14):
                yield rows(files[start : start + (1 << 14)])


def _contents(max_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (file_name, file_size, content) of rows (path, length); no content, and no opening, above the bound."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["file_name", "file_size", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                folder, name = path.rsplit("/", 1)
                content = None
                if length <= max_bytes:
                    system, root = _opened(folder)
                    with system.open_input_stream(f"{root}/{name}") as stream:
                        content = stream.read()
                    held += len(content)
                rows.append((name, length, content))
                if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield emit(rows)
                    rows, held = [], 0
        if rows:
            yield emit(rows)

    return read


def _files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Rows (file_name, file_size, content). The driver knows folders only: tasks list them, and the files, dealt out by their
    names, are read by other tasks. A file system that only Spark's readers can open is listed by the driver."""
    places = _places(spark, path)
    try:
        _opened(places[0][0] if places else "/")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        source = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
        names = F.col("_metadata.file_name").alias("file_name"), F.col("length").alias("file_size")
        large = source.filter(F.col("length") > max_bytes).select(*names, F.lit(None).cast("binary").alias("content"))
        return source.filter(F.col("length") <= max_bytes).select(*names, "content").unionAll(large)
    cores = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame(places, "place string, length long").repartition(max(min(len(places), 4 * cores), 1), "place")
    found = folders.mapInArrow(_listed, "path string, length long")
    return found.repartition(8 * cores, "path").mapInArrow(_contents(max_bytes), "file_name string, file_size long, content binary")


def read_directory(spark: SparkSession, path: str, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """One row per file directly inside `path`; a file that yields no text, as an empty one, is a failed row, not an abort.

    Lengths come from the listing: the content of a file above the bound is never opened; it is a failed row as well.
    `path` may be a pattern of folders. They are listed in the tasks, so that no list of all files meets on the driver.
    """
    kind = T.route_parser(F.col("file_name"))
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    is_html = T.file_extension(F.col("file_name")).isin("html", "htm")
    text = F.when(kind == "text", F.when(is_html, T.html_to_text(decoded)).otherwise(decoded))
    return (
        _files(spark, path, max_bytes)
        .withColumn("parser", kind)
        .withColumn("text", text)
        .withColumn("success", ~T.is_blank(F.col("text")))
        .withColumn(
            "message",
            F.when(F.col("file_size") > max_bytes, F.lit(f"larger than {max_bytes} bytes"))
            .when(F.col("success"), F.lit(None).cast("string"))
            .when(kind != "text", F.concat(F.lit("needs an external parser: "), kind))
            .otherwise(F.lit("no text in file")),
        )
        .drop("content")
    )


def write_directory(texts: DataFrame, path: str, shelves: int = 256, end: bytes = b"\n") -> int:
    """One file for each row of `texts` (text), in folders `shelf=n` below `path`; how many there are.

    The tasks make the files in place, so that no file is moved and nothing waits for the driver. A file is named by the
    partition of its row and its place there: a task that runs again overwrites what it wrote. On a local or mounted file
    system a file gets its name when it is whole, so that a task killed while it writes, as a copy of one that has
    ended, leaves no cut file; object stores do so by themselves. `end` closes each file. `path` must be new.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(path)
        named_last = isinstance(system, LocalFileSystem)
        partition, attempt, place, made = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, set()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                shelf = f"{root}/shelf={(partition + place) % shelves}"
                if shelf not in made:
                    system.create_dir(shelf, recursive=True)
                    made.add(shelf)
                name = f"{shelf}/{partition}-{place}.txt"
                first = f"{shelf}/_{partition}-{place}.{attempt}" if named_last else name
                with system.open_output_stream(first) as out:
                    out.write((text or b"") + end)
                if named_last:
                    system.move(first, name)
                place += 1
        yield pa.record_batch([pa.array([place], pa.int64())], names=["n"])

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
