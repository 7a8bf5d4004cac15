"""Sample, type-table and validation-set scans."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.scalars import basename

TYPE_TABLE_SCHEMA = T.StructType(
    [T.StructField("sha1", T.StringType()), T.StructField("file_type", T.StringType())]
)

#: rows of a list, and bytes of contents, that a task holds at a time
LISTED_ROWS, READ_BYTES = 10_000, 4_000_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan that would leave half of the cores idle, hashed over all cores.

    One large row group is one task otherwise. A scan with more splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df


def scan_samples(spark: SparkSession, folder: str, empty_files: bool = True) -> DataFrame:
    """Every file below `folder`, or one file: (sample_id, path, name, content BINARY).

    Files are named by their SHA1, so the path identifies a sample. Unreadable files are skipped;
    `unreadable_samples` names them. Files are listed and read in tasks, so neither paths nor contents
    pass the driver. With `empty_files` off Spark's own scan reads them, for a store that only Spark
    opens: it leaves empty files out, and its list is held by the driver.
    """
    found = _read(spark, folder) if empty_files else _scanned(spark, folder)
    return as_samples(found, "path", "path", "content")


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(folder)
        .select("path", "content")
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every file below `folder`, or of one file; names that begin with a dot or
    an underscore are left out, as in Spark's scans. One task lists `folder`, the others share its
    subfolders; no list passes the driver."""
    shape = "path string, length long, is_folder boolean"
    root = spark.createDataFrame([(folder,)], "path string").coalesce(1)
    top = root.mapInArrow(_lister(False), shape)
    below = top.filter("is_folder").select("path").repartition("path").mapInArrow(_lister(True), shape)
    return top.unionByName(below).filter("not is_folder").select("path", "length")


def _lister(recursive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for row in _listed(folder, recursive):
                    rows.append(row)
                    if len(rows) == LISTED_ROWS:
                        yield _listing(rows)
                        rows = []
                yield _listing(rows)

    return run


def _listing(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.bool_()),
        ],
        ["path", "length", "is_folder"],
    )


def _listed(folder: str, recursive: bool) -> Iterator[tuple[str, int, bool]]:
    """(path, length, is_folder) of what is in a folder, or of one file. A local folder is read entry by
    entry; other stores return the list of a folder at once."""
    store, base, prefix = open_store(folder)
    info = store.get_file_info([base])[0]
    if info.type != FileType.Directory:
        if not any(_hidden(part) for part in info.path[len(base) :].strip("/").split("/")):
            yield prefix + info.path, info.size or 0, False
        return
    folders = [base]
    while folders:
        place = folders.pop()
        for path, length, is_folder in _entries(store, place):
            if not _hidden(path.rsplit("/", 1)[-1]):
                yield prefix + path, length, is_folder
                if is_folder and recursive:
                    folders.append(path)


def _entries(store: FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    if isinstance(store, LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                # a link is what it leads to; one that leads nowhere is a file without content
                is_folder = entry.is_dir()
                yield entry.path, 0 if is_folder or not os.path.exists(entry.path) else entry.stat().st_size, is_folder
    else:
        for info in store.get_file_info(FileSelector(folder)):
            yield info.path, info.size or 0, info.type == FileType.Directory


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file of the list that can be read, read in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = open_store(folder)
        paths, contents, held = [], [], 0
        for batch in batches:
            for path, length in zip(*(column.to_pylist() for column in batch.columns)):
                content = b""
                if length:
                    try:
                        with store.open_input_stream(path[len(prefix) :], compression=None) as source:
                            content = source.read()
                    except OSError:
                        continue
                paths.append(path)
                contents.append(content)
                held += len(content) + len(path)
                if held >= READ_BYTES:
                    yield _contents(paths, contents)
                    paths, contents, held = [], [], 0
        yield _contents(paths, contents)

    # paths are few bytes beside what they name, so tasks must not be merged by them
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return list_files(spark, folder).repartition(tasks, "path").mapInArrow(run, "path string, content binary")


def _contents(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"]
    )


def open_store(folder: str) -> tuple[FileSystem, str, str]:
    """The store of a path, the path in it, and what stands before it in Spark's paths."""
    scheme = re.match(r"([A-Za-z][\w+.-]*):", folder)
    if not scheme or scheme[1] == "file":
        base = "/" + re.sub(r"^file:", "", folder).strip("/")
        return LocalFileSystem(), base, "file:"
    store, base = FileSystem.from_uri(folder)
    base = base.rstrip("/")
    return store, base, folder.rstrip("/").removesuffix(base)


def unreadable_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The paths that `scan_samples` skips: files that are listed, not empty, and have no content."""
    read = _read(spark, folder).filter("length(content) > 0").select("path")
    return list_files(spark, folder).filter("length > 0").select("path").join(read, "path", "left_anti")


def as_samples(df: DataFrame, sample_id: str, path: str, content: str) -> DataFrame:
    """A table of samples in the common shape (sample_id, path, name, content BINARY)."""
    return df.select(
        F.col(sample_id).alias("sample_id"),
        F.col(path).alias("path"),
        basename(F.col(path)).alias("name"),
        F.col(content).cast("binary").alias("content"),
    )


def labelled_corpus(html: DataFrame, no_html: DataFrame) -> DataFrame:
    """HTML samples with label 1 and all others with label 0."""
    return html.withColumn("label", F.lit(1)).unionByName(
        no_html.withColumn("label", F.lit(0))
    )


def list_sample_names(samples: DataFrame, path: str = "path") -> DataFrame:
    return samples.select(basename(F.col(path)).alias("name"))


def corpus_manifest(samples: DataFrame) -> DataFrame:
    """One path per sample, all classes together."""
    return samples.select("path")


def scan_type_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the header columns `SHA1` and `File Type`, in any order; an absent type reads as ''."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(
        F.col("SHA1").cast("string").alias("sha1"),
        F.coalesce(F.col("`File Type`").cast("string"), F.lit("")).alias("file_type"),
    )


def write_type_table(types: DataFrame, path: str) -> None:
    (
        types.select(F.col("sha1").alias("SHA1"), F.col("file_type").alias("File Type"))
        .write.option("header", True)
        .option("emptyValue", "")
        .csv(path)
    )


def validation_sets(
    samples: DataFrame, positive_root: str = "mal_set", negative_root: str = "nor_set"
) -> DataFrame:
    """Adds (set_name, label) from `.../<root>/<set_name>/...`; other paths are dropped."""
    path = F.col("path")
    root = F.regexp_extract(path, rf"(?:^|/)({positive_root}|{negative_root})/[^/]+/", 1)
    set_name: Column = F.regexp_extract(
        path, rf"(?:^|/)(?:{positive_root}|{negative_root})/([^/]+)/", 1
    )
    return (
        samples.filter(root != "")
        .withColumn("set_name", set_name)
        .withColumn("label", F.when(root == positive_root, 1).otherwise(0))
    )
