"""Sound files as splittable sources: levels of any range of a WAV file, and recordings stitched from ranges of others."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tempora.sources.files import importable, located

#: Frames read at a time, and seconds of sound in a block that is copied.
FRAMES, BLOCK = 5000, 60.0
#: Ranges of a source, about: beyond, ranges are longer, since a task costs more to begin than a short range to read.
MOST_RANGES = 1000


@dataclass(frozen=True)
class WavHead:
    """Where the samples of a WAV file lie."""

    rate: int
    channels: int
    bits: int
    at: int
    samples: int


def wav_head(file: BinaryIO, size: int, path: str = "") -> WavHead:
    """Read the chunks before the samples; a length that is missing, or more than the file holds, ends with the file."""
    head = file.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError(f"{path}: no WAV file")
    kind = None
    while len(chunk := file.read(8)) == 8:
        name, length = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"data":
            if kind is None:
                break
            _, channels, rate, _, _, bits = kind
            room = size - file.tell()
            return WavHead(rate, channels, bits, file.tell(), (min(length, room) if 0 < length < 0xFFFFFFFF else room) // (channels * bits // 8))
        body = file.read(length + length % 2)
        if name == b"fmt ":
            kind = struct.unpack("<HHIIHH", body[:16])
    raise ValueError(f"{path}: no samples")


@dataclass
class SoundRange(InputPartition):
    path: str
    head: WavHead
    first: int
    last: int


class SoundReader(DataSourceReader):
    """Plans ranges of 20 ms frames from the heads of the files, and reads each by itself."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.frame = float(options.get("frame", 0.02))
        self.per_task = int(options.get("framesPerTask", 180_000))
        self.want = [None if str(options.get(k, d)).lower() == "any" else int(options.get(k, d)) for k, d in (("rate", 16000), ("channels", 1))]

    def _paths(self) -> list[str]:
        place, top = located(self.path)
        info = place.get_file_info(top)
        if info.type == fs.FileType.File:
            return [self.path]
        root = self.path.rstrip("/")
        return sorted(root + f.path[len(top) :] for f in place.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))

    def partitions(self) -> list[SoundRange]:
        files = []
        for path in self._paths():
            place, at = located(path)
            with place.open_input_file(at) as f:
                head = wav_head(f, f.size(), path)
            if head.bits != 16 or any(w not in (None, h) for w, h in zip(self.want, (head.rate, head.channels), strict=True)):
                raise ValueError(f"{path}: {head.channels} channels of {head.bits} bits at {head.rate} Hz")
            files.append((path, head, head.samples // int(head.rate * self.frame)))
        each = max(self.per_task, -(-sum(n for *_, n in files) // MOST_RANGES))
        out = [SoundRange(path, head, a, min(n, a + each)) for path, head, n in files for a in range(0, n, each)]
        return out or [SoundRange("", WavHead(1, 1, 16, 0, 0), 0, 0)]

    def read(self, partition: SoundRange) -> Iterator[pa.RecordBatch]:
        p, head = partition, partition.head
        if p.first == p.last:
            return
        step = int(head.rate * self.frame)
        place, at = located(p.path)
        with place.open_input_file(at) as f:
            f.seek(head.at + p.first * step * head.channels * 2)
            for i in range(p.first, p.last, FRAMES):
                n = min(FRAMES, p.last - i)
                x = np.frombuffer(f.read(n * step * head.channels * 2), "<i2").astype(np.float64)
                x = x.reshape(-1, head.channels).mean(1) if head.channels > 1 else x
                power = (x.reshape(n, step) ** 2).mean(1)
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array(np.arange(i, i + n)), pa.array(10 * np.log10(power / 32768.0**2 + 1e-10))], names=["rec_id", "idx", "db"])


class SoundLevels(DataSource):
    """format("sound_levels"): (rec_id, idx, db) of 16-bit WAV files, in decibels of full scale for each 20 ms."""

    @classmethod
    def name(cls) -> str:
        return "sound_levels"

    def schema(self) -> str:
        return "rec_id string, idx long, db double"

    def reader(self, schema: StructType) -> SoundReader:
        return SoundReader(self.options)


def sound_levels(spark: SparkSession, path: str, rate: int | None = 16000, channels: int | None = 1, frames_per_task: int = 180_000) -> DataFrame:
    """(rec_id, idx, db) of a WAV file or of all under a folder; a task reads an hour of sound by default, so long files are many tasks.
    Where that would be more than MOST_RANGES tasks, each reads as much more.

    Files of another rate or number of channels are refused (None: any will do).  The last samples, fewer than a frame, are left out.
    """
    importable(spark).dataSource.register(SoundLevels)
    wanted = {"rate": rate, "channels": channels}
    options = {k: "any" if v is None else str(v) for k, v in wanted.items()} | {"framesPerTask": str(frames_per_task)}
    return spark.read.format("sound_levels").options(**options).load(path)


def wav_bytes(samples: int, rate: int) -> bytes:
    """The head of a WAV file of one channel of 16 bits."""
    return b"RIFF" + struct.pack("<I", 36 + 2 * samples) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", 2 * samples)


def wav_files(blocks: DataFrame, rate: int = 16000, times: int = 1) -> DataFrame:
    """(name, seq, content) for write_files: blocks (name, seq, content) of samples, 16 bits of one channel, and the head of each file before them.

    With ``times`` each content will be repeated so often when it is made (see write_files), which heads count.
    """
    n = F.sum(F.octet_length("content")) * times

    def little(c: Column) -> Column:
        h = F.lpad(F.hex(c), 8, "0")
        return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])

    fixed = wav_bytes(0, rate).hex().upper()
    per = blocks.groupBy("name").agg((F.min("seq") - 1).alias("seq"), n.alias("n"))
    head = per.select("name", "seq", F.unhex(F.concat(F.lit(fixed[:8]), little(F.col("n") + 36), F.lit(fixed[16:80]), little(F.col("n")))).alias("content"))
    return blocks.select("name", "seq", "content").unionByName(head)


def stitched(plan: DataFrame, rate: int = 16000, block: float = BLOCK) -> DataFrame:
    """(name, seq, content) for write_files: a WAV file for each name of plan (name, path, src_frame, dst_frame, n), silence between.

    plan says which samples of which files go where (see stitch_plan and sound_plan).  Samples are read in blocks, each by
    whichever task has it; where a file runs out there is silence.  Files of another rate or with more than one channel are refused.
    """
    most = int(block * rate)
    ends = plan.groupBy("name").agg(F.max(F.col("dst_frame") + F.col("n")).alias("total"))
    order = plan.select("name", "path", "src_frame", "dst_frame", "n")
    before = F.coalesce(F.lag(F.col("dst_frame") + F.col("n")).over(Window.partitionBy("name").orderBy("dst_frame")), F.lit(0))
    gaps = order.withColumn("_from", before).where("dst_frame > _from").select("name", F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("src_frame"), F.col("_from").alias("dst_frame"), (F.col("dst_frame") - F.col("_from")).alias("n"))
    head = ends.select("name", F.lit("").alias("path"), F.lit(0).cast("long").alias("src_frame"), F.lit(-1).cast("long").alias("dst_frame"), F.col("total").alias("n"))
    pieces = order.unionByName(gaps).where("n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))))
    pieces = pieces.select("name", "path", (F.col("src_frame") + F.col("_k") * most).alias("src_frame"), (F.col("dst_frame") + F.col("_k") * most).alias("dst_frame"), F.least(F.lit(most), F.col("n") - F.col("_k") * most).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["dst_frame"] < 0:
                    content = wav_bytes(r["n"], rate)
                elif r["path"] is None:
                    content = bytes(2 * r["n"])
                else:
                    place, at = located(r["path"])
                    with place.open_input_file(at) as f:
                        h = wav_head(f, f.size(), r["path"])
                        if (h.rate, h.channels, h.bits) != (rate, 1, 16):
                            raise ValueError(f"{r['path']}: {h.channels} channels of {h.bits} bits at {h.rate} Hz")
                        first = min(max(r["src_frame"], 0), h.samples)
                        f.seek(h.at + 2 * first)
                        content = f.read(2 * min(r["n"], h.samples - first))
                    content += bytes(2 * r["n"] - len(content))
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([r["dst_frame"]], pa.int64()), pa.array([content], pa.binary())], names=["name", "seq", "content"])

    importable(plan.sparkSession)
    return pieces.unionByName(head).mapInArrow(run, "name string, seq long, content binary")
