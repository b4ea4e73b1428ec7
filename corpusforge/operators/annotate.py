"""Annotate records with a pluggable model in batches, with retries.

``model_factory`` is pickled to the executors and called once per Python
worker; ``Model.ask(list[str]) -> list[str]`` answers a batch of prompts.
Prompts are rendered by Spark expressions before the Python step, and the
result must be materialised (``materialize``) before it is read twice, so a
sampling model is never called again for the same record.
"""

from __future__ import annotations

import asyncio
import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.prompts import render_template
from corpusforge.session import shared_dir

#: Bytes of rows that are given to a model's caller at a time.
SLICE_BYTES = 4 << 20
_MODELS: dict = {}


class PrefixModel:
    """Offline stand-in model: the answer is the first ``n`` characters of the prompt.

    ``max_prompt_chars`` makes it refuse prompts that are too long (a
    deterministic failure, to exercise retries and rejects).
    """

    def __init__(self, n: int = 256, max_prompt_chars: int | None = None):
        self.n, self.max_prompt_chars = n, max_prompt_chars

    def ask(self, batch: list[str]) -> list[str]:
        if self.max_prompt_chars is not None and any(len(p) > self.max_prompt_chars for p in batch):
            raise ValueError("prompt too long")
        return [p[: self.n] for p in batch]


def row_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES):
    """Runs of rows of a batch of about ``most`` bytes, so that few rows at a time become Python objects."""
    rows = max(1, most * batch.num_rows // max(batch.nbytes, 1))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _model(factory: Callable):
    # the factory is unpickled again for every task: key on its pickled bytes
    key = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()
    m = _MODELS.get(key)
    if m is None:
        m = _MODELS[key] = factory()
    return m


def _checked(answers, prompts: list) -> list:
    """A model that gives another number of answers, or none for a prompt, has failed."""
    ans = list(answers)
    if len(ans) != len(prompts):
        raise ValueError(f"{len(ans)} answers to {len(prompts)} prompts")
    if any(a is None for a in ans):
        raise ValueError("a prompt has no answer")
    return ans


def _ask(model, prompts: list) -> list:
    """One call."""
    return _checked(model.ask(prompts), prompts)


def _ask_all(model, prompts: list, batch_size: int, attempts: int):
    """Answers, errors and attempt counts per prompt; a failing batch is retried row by row."""
    n = len(prompts)
    out, err, tries = [None] * n, [None] * n, [0] * n
    for s in range(0, n, batch_size):
        span = range(s, min(s + batch_size, n))
        idx = [i for i in span if prompts[i] is not None]
        for i in span:
            if prompts[i] is None:
                err[i] = "null prompt"
        if not idx:
            continue
        try:
            for i, a in zip(idx, _ask(model, [prompts[i] for i in idx])):
                out[i], tries[i] = a, 1
            continue
        except Exception:  # noqa: BLE001 - fall back to one prompt at a time
            pass
        for i in idx:
            for k in range(1, attempts + 1):
                tries[i] = k
                try:
                    out[i] = _ask(model, [prompts[i]])[0]
                    err[i] = None
                    break
                except Exception as e:  # noqa: BLE001
                    err[i] = f"{type(e).__name__}: {e}"
    return out, err, tries


def _ask_all_concurrent(model, prompts: list, batch_size: int, attempts: int, in_flight: int, backoff: float):
    """As ``_ask_all``, with up to ``in_flight`` calls at a time; answers stay in the order of the prompts.

    A model's coroutine ``ask_async`` is awaited; a plain ``ask`` runs in a thread.
    Before attempt k + 1 of a prompt, its call waits ``backoff * 2 ** (k - 1)`` seconds.
    """
    n = len(prompts)
    out, err, tries = [None] * n, [None if p is not None else "null prompt" for p in prompts], [0] * n
    spans = [[i for i in range(s, min(s + batch_size, n)) if prompts[i] is not None] for s in range(0, n, batch_size)]

    async def run(pool):
        gate, loop = asyncio.Semaphore(in_flight), asyncio.get_running_loop()

        async def call(batch):
            async with gate:
                if hasattr(model, "ask_async"):
                    return _checked(await model.ask_async(batch), batch)
                return _checked(await loop.run_in_executor(pool, model.ask, batch), batch)

        async def one(i):
            for k in range(1, attempts + 1):
                tries[i] = k
                try:
                    out[i], err[i] = (await call([prompts[i]]))[0], None
                    return
                except Exception as e:  # noqa: BLE001
                    err[i] = f"{type(e).__name__}: {e}"
                if k < attempts:
                    await asyncio.sleep(backoff * 2 ** (k - 1))  # no call is in flight meanwhile

        async def span(idx):
            try:
                for i, a in zip(idx, await call([prompts[i] for i in idx])):
                    out[i], tries[i] = a, 1
            except Exception:  # noqa: BLE001 - fall back to one prompt at a time
                await asyncio.gather(*map(one, idx))
        await asyncio.gather(*[span(idx) for idx in spans if idx])

    with ThreadPoolExecutor(in_flight) as pool:
        asyncio.run(run(pool))
    return out, err, tries


def annotate(df: DataFrame, template: str, out: str, model_factory: Callable,
             batch_size: int = 8, attempts: int = 3, keep_prompt: bool = True, in_flight: int = 1,
             backoff: float = 0.0) -> DataFrame:
    """Add column ``out`` (and ``<out>_prompt``) answered by the model.

    Rows the model could not answer within ``attempts`` keep ``out`` null and
    carry ``_error`` / ``_attempts``; use ``split_rejects`` after materialising.
    ``in_flight`` over 1 lets a task wait for that many calls at a time (an event
    loop in each batch), with the same rows as the serial form; ``backoff`` is the
    wait in seconds before a prompt is tried again, doubled each time.
    """
    if in_flight < 1:
        raise ValueError(f"in_flight must be 1 at least: {in_flight}")
    prompt_col = f"{out}_prompt"
    x = df.withColumn(prompt_col, render_template(df, template))
    schema = T.StructType(list(x.schema.fields) + [
        T.StructField(out, T.StringType()), T.StructField("_error", T.StringType()),
        T.StructField("_attempts", T.IntegerType())])

    def run(batches):
        model = _model(model_factory)
        for whole in batches:
            for b in row_slices(whole):
                asked = b.column(prompt_col).to_pylist()
                ans, err, tries = (_ask_all(model, asked, batch_size, attempts) if in_flight == 1 else
                                   _ask_all_concurrent(model, asked, batch_size, attempts, in_flight, backoff))
                made = [pa.array(ans, pa.string()), pa.array(err, pa.string()), pa.array(tries, pa.int32())]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)

    res = x.mapInArrow(run, schema)
    return res if keep_prompt else res.drop(prompt_col)


def materialize(df: DataFrame, name: str = "annotated") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage so model calls run once."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def split_rejects(annotated: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """(answered rows, rejects (keys..., error, attempts)) from a materialised annotation."""
    good = annotated.filter(F.col("_error").isNull() & F.col(out).isNotNull()).drop("_error", "_attempts")
    bad = annotated.filter(F.col("_error").isNotNull()).withColumnRenamed("_error", "error") \
        .withColumnRenamed("_attempts", "attempts")
    return good, bad


def annotate_chain(df: DataFrame, steps: list[dict], model_factory: Callable, **kw) -> DataFrame:
    """A list of {prompt, out} steps; a later prompt may use an earlier ``out``.

    ``_error`` is the first step's that failed, with its output column, and
    ``_attempts`` the calls of all steps, so ``split_rejects`` on the last
    output column keeps every record in one of its two results.
    """
    x = df.withColumn("_chain_error", F.lit(None).cast("string")).withColumn("_chain_attempts", F.lit(0))
    for st in steps:
        x = annotate(x, st["prompt"], st["out"], model_factory, **kw)
        failed = F.when(F.col("_error").isNotNull(), F.concat(F.lit(st["out"] + ": "), F.col("_error")))
        x = (x.withColumn("_chain_error", F.coalesce("_chain_error", failed))
             .withColumn("_chain_attempts", F.col("_chain_attempts") + F.col("_attempts")).drop("_error", "_attempts"))
    return x.withColumnRenamed("_chain_error", "_error").withColumnRenamed("_chain_attempts", "_attempts")
