"""Named files written whole or not at all, and byte ranges of files; any file system that Arrow knows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> SparkSession:
    """Python workers that start from here on can import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the place in it of a path or URI (file:/a and file:///a alike)."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def joined(contents: pa.Array) -> Iterator[pa.Buffer]:
    """The bytes of contents, one after another; those that lie together come together.  A null adds nothing."""
    if contents.null_count or contents.type != pa.binary():
        yield from (c.as_buffer() for c in contents if c.is_valid)
    elif len(contents):
        ends = np.frombuffer(contents.buffers()[1], np.int32)[contents.offset : contents.offset + len(contents) + 1]
        if ends[-1] > ends[0]:
            yield contents.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NamedFilesWriter(DataSourceArrowWriter):
    """Tasks write under a folder of this run; commit moves whole files to their names, abort leaves nothing."""

    def __init__(self, folder: str):
        self.folder, self.run = folder, f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Contents of a name come one after another, in order."""
        from pyspark import TaskContext

        place, top = located(self.folder)
        mine = f"{top}/{self.run}/{TaskContext.get().taskAttemptId()}"
        place.create_dir(mine, recursive=True)
        names, now, out = [], None, None
        try:
            for batch in iterator:
                given, content = batch.column("name").to_pylist(), batch.column("content")
                first = [i for i in range(len(given)) if not i or given[i] != given[i - 1]]
                for a, b in zip(first, [*first[1:], len(given)], strict=True):
                    name = given[a]
                    if name != now:
                        if not name or os.path.basename(name) != name or name.startswith("_run-"):
                            raise ValueError(f"no name for a file: {name!r}")
                        if out is not None:
                            out.close()
                        now, out = name, place.open_output_stream(f"{mine}/{name}")
                        names.append(f"{mine}/{name}")
                    for part in joined(content.slice(a, b - a)):
                        out.write(part)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        place, top = located(self.folder)
        for message in messages:
            for name in message.names if message else []:
                place.move(name, f"{top}/{os.path.basename(name)}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        place, top = located(self.folder)
        if place.get_file_info(f"{top}/{self.run}").type != fs.FileType.NotFound:
            place.delete_dir(f"{top}/{self.run}")


class NamedFiles(DataSource):
    """format("named_files"): rows (name, seq, content), the contents of a name joined in the order they come."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, seq long, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_files(contents: DataFrame, folder: str, made: Column | None = None) -> None:
    """Write contents (name, seq, content) to files in a folder: each name's contents in the order of seq, files with those names replaced.

    One task streams a file, a content at a time.  Files appear under their names only after all tasks have ended well; a
    task that fails, or a run that is stopped, changes no file.  A null content adds nothing; a name that is empty, null or
    no plain name is refused.  Where ``made`` says how contents come from what contents holds instead (name, seq, content), they are made
    after rows are dealt and in order, so that rows stay short until then.
    """
    spark = importable(contents.sparkSession)
    spark.dataSource.register(NamedFiles)
    dealt = contents.select("name", F.col("seq").cast("long").alias("seq"), F.col("content").cast("binary").alias("content")).repartition("name").sortWithinPartitions("name", "seq")
    if made is not None:
        dealt = dealt.select("name", "seq", made.cast("binary").alias("content"))
    dealt.write.format("named_files").option("path", folder).mode("append").save()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one where that is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
