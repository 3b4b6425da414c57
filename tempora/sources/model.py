"""The boundary to a language model: prompts in, replies out, each prompt asked once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.sources.files import importable, located

#: Models that this worker has loaded, by name.
_LOADED: dict[str, Callable[[str], str]] = {}


def keyed(prompts: DataFrame, model: str = "") -> DataFrame:
    """prompts with ``key``: the hash of the model's name and the prompt."""
    return prompts.withColumn("key", F.sha2(F.concat(F.lit(model), F.lit("\n"), F.coalesce("prompt", F.lit(""))), 256))


def supplied(prompts: DataFrame, replies: DataFrame, model: str = "") -> DataFrame:
    """prompts with key, reply and error from a table of replies (key, reply); a prompt without one has the error ``no reply``."""
    told = replies.groupBy("key").agg(F.min("reply").alias("reply"))
    return keyed(prompts, model).join(told, "key", "left").withColumn("error", F.when(F.col("reply").isNull(), "no reply"))


def asked(prompts: DataFrame, model: str, load: Callable[[], Callable[[str], str]], kept: str, at_once: int = 8) -> DataFrame:
    """prompts (prompt, ...) with key, reply and error, from the model that load gives.

    load runs once in each worker; what it returns is called with a prompt.  Equal prompts are one question.  A reply is kept
    in the folder ``kept``, which all workers share, under the prompt's key before it is handed on, so a task that runs again, or a
    later run, asks nothing twice.  A call that fails gives its error, a null reply, and is not kept.  At most ``at_once`` tasks ask
    at a time.
    """
    questions = keyed(prompts, model).select("key", F.coalesce("prompt", F.lit("")).alias("prompt")).dropDuplicates(["key"]).repartition(at_once, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = located(kept)
        place.create_dir(top, recursive=True)
        for batch in batches:
            rows = []
            for key, prompt in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                name, error = f"{top}/{key}.json", None
                if place.get_file_info(name).type == fs.FileType.File:
                    with place.open_input_stream(name) as f:
                        reply = json.loads(f.read())["reply"]
                else:
                    try:
                        if model not in _LOADED:
                            _LOADED[model] = load()
                        reply = str(_LOADED[model](prompt))
                    except Exception as e:  # whatever a client raises becomes a row
                        reply, error = None, f"{type(e).__name__}: {e}"[:300]
                    else:
                        from pyspark import TaskContext

                        draft = f"{name}.{TaskContext.get().taskAttemptId()}"
                        with place.open_output_stream(draft) as f:
                            f.write(json.dumps({"reply": reply}).encode())
                        place.move(draft, name)
                rows.append((key, reply, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["key", "reply", "error"])

    importable(prompts.sparkSession)
    told = questions.mapInArrow(run, "key string, reply string, error string")
    return keyed(prompts, model).join(told, "key")
