"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of text, and rows, that a worker works on at a time, whatever the length of the Arrow batches Spark hands it.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Most bits of a Bloom filter (16 MB); beyond a tenth as many entries it only lets more others pass.
BLOOM_BITS = 1 << 27


_TIDIED = [0.0]


def tidy(every: float = 1.0) -> None:
    """Give memory that this worker no longer uses back to the machine, once in ``every`` seconds at most.

    Workers live on between stages; what the largest slice once took would otherwise stay with them while other stages run.
    """
    if time.monotonic() - _TIDIED[0] < every:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
    _TIDIED[0] = time.monotonic()


def tidied(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for applyInArrow, after which tidy() runs, when what f held is free."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        tidy()
        return out

    return run


def prepare(spark: SparkSession, rows: int = SLICE_ROWS) -> SparkSession:
    """Let Python workers import this package; where the session leaves Arrow batches at Spark's default, hold them to so many rows.

    Batches are whole texts here: ten thousand rows of them, in the JVM and in a worker, are what fills an executor.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of at most ``most`` bytes of the column (or one row) and SLICE_ROWS rows; nothing is copied.

    Memory that is free then goes back after the last.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(upto, before + most, "right"))), at + SLICE_ROWS)
            yield batch.slice(at, end - at)
            at = end
    batch = None
    tidy(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is named and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that cut() wrote, or what reads() names, once no later plan reads it."""
    for path in getattr(df, "_cut_path", "").split():
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def reads(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, for which release() deletes the tables of cut() that it reads; for results that are written before they are used."""
    df._cut_path = " ".join(t._cut_path for t in tables)
    return df


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def bloom(ids: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(bits, filter) of a column of evenly spread 64-bit numbers: ten bits for each, two of them set, BLOOM_BITS at most."""
    bits = min(BLOOM_BITS, max(1 << 15, 1 << (10 * ids.count()).bit_length()))
    x = F.col(column)  # Spark's buckets and positions count from 1
    at = ids.select(F.explode(F.array(x.bitwiseAND(bits - 1) + 1, F.shiftrightunsigned(x, 32).bitwiseAND(bits - 1) + 1)).alias("at"))
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect()  # at most BLOOM_BITS bits
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks:
        out[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return bits, out


def in_bloom(key: np.ndarray, bits: int, known: np.ndarray) -> np.ndarray:
    key = key.view(np.uint64)
    ok = np.ones(len(key), bool)
    for at in (key & np.uint64(bits - 1), (key >> np.uint64(32)) & np.uint64(bits - 1)):
        ok &= ((known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return ok


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def numbered_words(column: pa.Array, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """(numbers, bounds, words): the words of all texts of a column as numbers of its distinct words.

    Text i has numbers[bounds[i]:bounds[i + 1]]; null has none.  Words are split at white space; with ascii_only at
    [\\x20\\x09-\\x0D], and they come as bytes.
    """
    column = pc.fill_null(column, "")
    lists = pc.ascii_split_whitespace(column) if ascii_only else pc.utf8_split_whitespace(column)
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    coded = flat.dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # white space at the ends of a text leaves empty strings
        real = numbers != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        numbers = numbers[real]
    words = coded.dictionary.cast(pa.binary()) if ascii_only else coded.dictionary
    return numbers, bounds, words.to_pylist()


def every_character() -> str:
    """All code points but surrogates, decoded from numbers: a list of a million strings would take 120 MB for a moment."""
    return np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (smallest member, member) of the components of one batch of edges."""
    ids, inverse = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = inverse[: len(src)], inverse[len(src) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    kept = label != np.arange(len(ids))
    return ids[label[kept]], ids[kept]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each run of batches by a spanning forest; memory is bounded by the run."""
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate(src), np.concatenate(dst))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        src.append(batch.column("src").to_numpy())
        dst.append(batch.column("dst").to_numpy())
        held += batch.num_rows
        if held >= 2_000_000:
            done = out()
            src, dst, held = [done.column(0).to_numpy()], [done.column(1).to_numpy()], done.num_rows
            if held >= 1_000_000:
                yield done
                src, dst, held = [], [], 0
    if held:
        yield out()


def contracted(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges; narrow, each partition for itself."""
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(_contract, "src long, dst long")


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, component_id) of every id on an edge (src, dst); component_id is the smallest id that edges reach.

    Alternates large-star and small-star steps, which need minima by node and joins only: no node's
    neighbours are ever gathered.  Each round is written to the shared folder; the number of rounds grows with the square of
    the logarithm of the number of ids at most, and ``rounds`` only keeps a fault from running for ever.  Null ends are ignored;
    ids without an edge to another id have no row.
    """
    now = cut(contracted(edges.where("src is not null and dst is not null and src <> dst")), "cc")

    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(low, "u")
        if large:
            found = joined.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        else:
            found = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("src"), F.col("x.m").alias("dst"))
        return found.where("src <> dst").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1_000_003), F.sum(F.xxhash64("dst", "src") % 1_000_033)).first())

    before = None
    for _ in range(rounds):
        nxt = cut(star(star(now, True), False), "cc")
        release(now)
        now, at = nxt, state(nxt)
        if at == before or not at[0]:
            break
        before = at
    else:
        raise RuntimeError("components did not settle")
    ids = now.select(F.col("src").alias("id"), F.col("dst").alias("component_id"))
    return reads(ids.unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("component_id")).distinct()), now)
