"""Operator 4: chat formatting in budgeted windows.

1.  Turns are counted in tokens.  Prefix sums of the counts, first inside blocks of turns and then over the blocks of a
    conversation, need no conversation in one task.
2.  A turn belongs to the window that its first token falls into (windows are ``span`` tokens wide), so windows are
    aligned to turns.  Each window is led by the conversation's system turn and by those turns before it that start
    within the last ``history`` tokens; both are repeated, and masked.
3.  The template marks turns as ``### role:`` ... ``</turn>``.  Inside texts and roles a backslash is put before
    backslashes and before both marks, so the output can be read back.
The loss mask covers the text of each assistant turn in the window that it belongs to, and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import SLICE_BYTES, cut, parallelism, prepare, reads, release, slices
from tempora.llm.token_counts import counter

BLOCK = 256
#: Roles whose text is learned, and the role of the turn that leads every window.
TARGET, LEAD = "assistant", "system"
TURN = re.compile(r"### ((?:[^\\:]+|\\.)*+):\n((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends in it."""
    head = "### " + escape(role).replace(":", "\\:") + ":\n"
    body = escape(text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches):
            role, text = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
            n = count([format_turn(r, t)[0] for r, t in zip(role, text, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64())], names=["conv_id", "turn", "role", "text", "tokens"])

    return run


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64(), pa.int64()]
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "window_id", "formatted", "loss_spans", "n_context", "n_targets", "n_tokens"])

    for batch in batches:
        size = 0
        for conv, window, turns in ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()) for i in range(batch.num_rows)):
            parts, at, spans, context = [], 0, [], 0
            for t in turns:
                text, a, b = format_turn(t["role"], t["text"])
                if t["kind"] < 2:
                    context += 1
                elif t["role"] == TARGET:
                    spans.append({"start": at + a, "end": at + b})
                parts.append(text)
                at += len(text)
            out.append((conv, window, "".join(parts), spans, context, len(turns) - context, sum(t["tokens"] for t in turns)))
            size += at
            if size >= SLICE_BYTES:
                yield made()
                out.clear()
                size = 0
        if out:
            yield made()
            out.clear()


def chat_windows(turns: DataFrame, path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, window_id, formatted, loss_spans, n_context, n_targets, n_tokens) for turns (conv_id, turn, role, text, ...).

    span is half of what the history leaves of the budget, so a window without its system turn is over budget only if it
    holds a turn longer than span; a turn is never cut.  Null roles and texts are empty; null turns come first; turns
    with one number are ordered by role and text, and repeated rows are turns of their own; rows without conv_id form one
    conversation.  The first turn leads every window if its role is system.  loss_spans are in code points.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = prepare(turns.sparkSession)
    span = max(1, (budget - history) // 2)
    counted = cut(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(_counted(path), "conv_id long, turn long, role string, text string, tokens long"), "chat")
    keyed = counted.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("upto", F.sum("tokens").over(inside)).withColumn("nth", F.row_number().over(inside))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).alias("block")).agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("turns_before"))
    placed = keyed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "role", "text", "tokens", (F.col("before") + F.col("upto") - F.col("tokens")).alias("start"), (F.col("turns_before") + F.col("nth") - 1).alias("idx"))
    placed = cut(placed.withColumn("window_id", F.floor(F.col("start") / span)), "chat")
    release(counted)
    lead = (F.col("idx") == 0) & (F.col("role") == LEAD)
    later = F.when(~lead & (F.col("start") >= (F.col("window_id") + 1) * span - history), F.array(F.struct((F.col("window_id") + 1).alias("window_id"), F.lit(1).alias("kind"))))
    dealt = placed.withColumn("at", F.explode(F.concat(F.array(F.struct("window_id", F.lit(2).alias("kind"))), F.coalesce(later, F.array().cast("array<struct<window_id:bigint,kind:int>>"))))).select("conv_id", "at.window_id", "at.kind", "idx", "role", "text", "tokens")
    leads = placed.where(lead).select(F.col("conv_id").alias("c"), "idx", "role", "text", "tokens")
    others = placed.where("window_id > 0").select("conv_id", "window_id").distinct()
    led = others.join(leads, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "window_id", F.lit(0).alias("kind"), "idx", "role", "text", "tokens")
    grouped = dealt.unionByName(led).groupBy("conv_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("kind", "idx", "role", "text", "tokens"))).alias("turns"))
    grouped = grouped.where(F.exists("turns", lambda t: t["kind"] == 2))
    grouped = grouped.select("conv_id", "window_id", "turns")
    return reads(grouped.mapInArrow(_formatted, "conv_id long, window_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, n_context long, n_targets long, n_tokens long"), placed)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests by conversation from windows in order; holds one window at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    now, out = None, []

    def close() -> None:
        if now is not None:
            out.append((now["conv"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["formatted"], now["windows"]))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for conv, text, spans, context in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "n_context")), strict=True):
            if now is None or now["conv"] != conv:
                close()
                now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "windows": 0}
            for role, said in read_turns(text)[context:]:
                now["turns"] += 1
                now["all"].update(f"{role}\n{said}\n".encode())
            for s in spans:
                said = unescape(text[s["start"] : s["end"]])
                now["chars"] += len(said)
                now["loss"].update(said.encode())
            now["formatted"] += len(text)
            now["windows"] += 1
        if len(out) >= 1000:
            yield batch_of()
            out.clear()
    close()
    if out:
        yield batch_of()


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows hold: turns, digests of turns and of the text under the mask, sizes.

    A digest needs the windows of a conversation in order, so they stream through one task; nothing is gathered.
    """
    dealt = windows.repartition(parallelism(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window_id")
    return dealt.select("conv_id", "formatted", "loss_spans", "n_context").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
