"""A data source that lists files, for catalogues: `spark.read.format("file_catalogue").option("path", ...)`.

The driver lists only the paths given and what lies directly in them; each subfolder is a partition, which a task lists to
its end. Contents are not read. Paths may be of any file system that pyarrow knows (local or mounted, s3, hdfs).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.sources.files import file_format, structure

LISTED = "path string, name string, size_bytes long, modified timestamp"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in self.paths:
            system, inner = _at(path)
            [info] = system.get_file_info([inner])
            if info.type == fs.FileType.NotFound:
                continue
            parts.append(_Folder(path, False))  # the file, or the files of the folder itself
            if info.type == fs.FileType.Directory and self.recursive:
                start = path[: len(path) - len(inner)]
                parts += [_Folder(start + f.path, True) for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory]
        return parts or [_Folder("", False)]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, inner = _at(partition.path)
        [top] = system.get_file_info([inner])
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=partition.deep, allow_not_found=True))
        some = [f for f in found if f.type == fs.FileType.File and (self.hidden or not f.base_name.startswith("."))]
        for i in range(0, len(some), 10_000):
            own = some[i : i + 10_000]
            columns = [pa.array([f.path for f in own]), pa.array([f.base_name for f in own]), pa.array([f.size for f in own], pa.int64()), pa.array([f.mtime for f in own], pa.timestamp("us", "UTC"))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "name", "size_bytes", "modified"])


class FileCatalogue(DataSource):
    """The files at a list of paths (option `paths`, a JSON list), in subfolders too unless `recursive` is false; names that
    begin with a dot only with `hidden`."""

    @classmethod
    def name(cls) -> str:
        return "file_catalogue"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def source_id(path: Column) -> Column:
    """The number of a file in the catalogue, from its absolute path."""
    return F.left(F.md5(path), F.lit(12))


def discover(spark: SparkSession, paths: list[str], *, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """source_id, name, path, format, source_type, size_bytes, modified, description: the files of known formats.

    A path that does not exist gives nothing; a file met by way of two paths counts once.
    """
    spark.dataSource.register(FileCatalogue)
    options = {"paths": json.dumps(paths), "recursive": str(recursive), "hidden": str(hidden)}
    found = spark.read.format("file_catalogue").options(**options).load().withColumn("format", file_format(F.col("name"))).where("format is not null")
    return found.select(
        source_id(F.col("path")).alias("source_id"), "name", "path", "format", structure(F.col("format")).alias("source_type"), "size_bytes", "modified",
        F.concat(F.lit("Document: "), "name").alias("description"),
    ).dropDuplicates(["source_id"])


def search(found: DataFrame, *, query: str = "", source_type: str | None = None, form: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Sources whose name or description holds `query` in either case, of a type, a format and a range of sizes if given."""
    wanted = F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower("description"), F.lit(query.lower()))
    for test in (
        source_type is None or F.col("source_type") == source_type,
        form is None or F.col("format") == form,
        least is None or F.col("size_bytes") >= least,
        most is None or F.col("size_bytes") <= most,
    ):
        wanted = wanted if test is True else wanted & test
    return found.where(wanted)


def write_each(rows: DataFrame, folder: str) -> int:
    """Write each of `rows` (path, content) as a file of its own below `folder`, and return how many; null contents are none.

    A task that is run again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(folder)
        done, made = 0, set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent = f"{root}/{path}".rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{root}/{path}") as out:
                    out.write(content)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    given = rows.where("content is not null").select("path", F.col("content").cast("string").cast("binary").alias("content"))
    return given.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
