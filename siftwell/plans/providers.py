"""Plug-ins for outside models: requests by budget, retries, failures told row by row; deterministic offline calls."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from siftwell.functions.text import approx_tokens

#: Status codes that are tried again (fixed values); None is a broken connection.
RETRYABLE = frozenset({None, 408, 429, 500, 502, 503, 504})


class ProviderError(RuntimeError):
    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


class Exhausted(ProviderError):
    """All attempts failed; the component counts as unavailable."""


def with_retry(call: Callable, attempts: int = 5, base: float = 1.0, most: float = 30.0, sleep: Callable = time.sleep, spread: Callable[[float], float] = lambda wait: wait):
    """``call()`` again after retryable errors, waiting twice as long each time (``spread`` varies it), or as long as the server asks."""
    for k in range(attempts):
        try:
            return call()
        except ProviderError as error:
            if error.status not in RETRYABLE:
                raise
            if k == attempts - 1:
                raise Exhausted(str(error), error.status) from error
            sleep(min(most, error.retry_after) if error.retry_after is not None else spread(min(most, base * 2**k)))
    raise ValueError("attempts must be positive")


def jitter(seed: int) -> Callable[[float], float]:
    own = random.Random(seed)
    return lambda wait: wait * (0.5 + own.random() / 2)


@dataclass(frozen=True)
class Budget:
    """What one request may hold.  A row's parts (a document's chunks) never go apart."""

    tokens: int = 120_000
    parts: int = 16_000
    rows: int = 1_000
    part_tokens: int = 32_000


class Reply(NamedTuple):
    """A provider's values, and what it says of each row's tokens and time; a plain list of values says nothing."""

    values: list
    input_tokens: list[int] | None = None
    output_tokens: list[int] | None = None
    duration_ms: list[float] | None = None


def requests(rows: Iterable[tuple[object, list[int]]], budget: Budget) -> Iterator[tuple[list, str | None]]:
    """Rows (each with the tokens of its parts) in requests: contiguous, greedy, a row never split.

    A row that no request can hold comes by itself, with the reason.
    """
    held, tokens, parts = [], 0, 0
    for row, sizes in rows:
        own = sum(sizes)
        if own > budget.tokens or len(sizes) > budget.parts or max(sizes, default=0) > budget.part_tokens:
            if held:
                yield held, None
                held, tokens, parts = [], 0, 0
            yield [row], f"{own} tokens in {len(sizes)} parts are over the budget of a request"
            continue
        if held and (tokens + own > budget.tokens or parts + len(sizes) > budget.parts or len(held) >= budget.rows):
            yield held, None
            held, tokens, parts = [], 0, 0
        held.append(row)
        tokens, parts = tokens + own, parts + len(sizes)
    if held:
        yield held, None


STATUS = "ok boolean, value {kind}, error string, input_tokens long, output_tokens long, duration_ms double, request long"


class _Sender:
    """Sends requests and tells of every row how it went: a failed request is halved until only rows that fail by themselves have failed."""

    def __init__(self, call: Callable, kind: pa.DataType, fits: Callable | None, attempts: int, sleep: Callable, clock: Callable, seed: int):
        self.call, self.kind, self.fits, self.attempts, self.sleep, self.clock, self.wait = call, kind, fits, attempts, sleep, clock, jitter(seed)

    def _once(self, given: list, attempts: int) -> list[tuple]:
        def asked():
            try:
                return self.call(given)
            except (ConnectionError, TimeoutError) as error:
                raise ProviderError(str(error)) from error

        began = self.clock()
        reply = with_retry(asked, attempts, sleep=self.sleep, spread=self.wait)
        took = (self.clock() - began) * 1000
        reply = reply if isinstance(reply, Reply) else Reply(reply)
        n = len(given)
        if len(reply.values) != n or (self.fits is not None and not all(v is None or self.fits(g, v) for g, v in zip(given, reply.values))):
            raise ProviderError("the answers do not fit the questions", 422)
        try:
            pa.array(reply.values, self.kind)
        except (pa.ArrowException, TypeError, ValueError) as error:
            raise ProviderError(f"the answers are not {self.kind}: {error}", 422) from error
        told = [x if x is not None else [0] * n for x in (reply.input_tokens, reply.output_tokens)]
        return [(True, v, None, i, o, t) for v, i, o, t in zip(reply.values, *told, reply.duration_ms or [took] * n)]

    def send(self, given: list, attempts: int | None = None) -> list[tuple]:
        began = self.clock()
        try:
            return self._once(given, attempts or self.attempts)
        except ProviderError as error:
            if len(given) == 1:
                return [(False, None, f"{type(error).__name__}: {error}", 0, 0, (self.clock() - began) * 1000)]
        mid = len(given) // 2
        return self.send(given[:mid], 1) + self.send(given[mid:], 1)


def provided(
    rows: DataFrame, call: Callable[[list], list | Reply], inputs: list[str], kind: str, keys: list[str], sizes: Column | None = None, budget: Budget = Budget(),
    fits: Callable | None = None, attempts: int = 5, sleep: Callable = time.sleep, clock: Callable = time.perf_counter,
) -> DataFrame:
    """A model over rows: ``keys`` and how each row went (STATUS), written once, for a plan may read it often.

    ``call`` gets a list of inputs (tuples, where there are several columns) and
    returns as many values of the type ``kind``, or a :class:`Reply`.  Requests
    are cut by ``sizes`` (tokens of each of a row's parts; approximate tokens of
    the first input if it is left out) and go on across the batches of a
    partition.  A row that fails, or whose value does not fit, has ``ok`` false
    and an error, and takes no other row with it; the job never fails for it.
    """
    from siftwell.operators.graph import settle

    kind_sql, value = STATUS.format(kind=kind), to_arrow_type(StructType.fromDDL(f"value {kind}")[0].dataType)
    sizes = F.array(approx_tokens(F.coalesce(F.col(inputs[0]).cast("string"), F.lit("")))) if sizes is None else sizes
    picked = rows.select(*keys, *(F.col(c).alias(f"__in{k}") for k, c in enumerate(inputs)), sizes.cast("array<long>").alias("__sizes"))
    n_keys, n_in = len(keys), len(inputs)

    def work(batches):
        number = TaskContext.get().partitionId()
        sender = _Sender(call, value, fits, attempts, sleep, clock, number)

        def one_by_one():
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns):
                    given = row[n_keys] if n_in == 1 else row[n_keys : n_keys + n_in]
                    yield (row[:n_keys], given), row[-1] or []

        kinds = None
        for k, (part, reason) in enumerate(requests(one_by_one(), budget)):
            told = [(False, None, f"ValueError: {reason}", 0, 0, 0.0)] if reason else sender.send([given for _, given in part])
            kinds = kinds or [*key_kinds, pa.bool_(), value, pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            columns = [*zip(*(key for key, _ in part)), *zip(*told), [number << 32 | k] * len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = [*keys, "ok", "value", "error", "input_tokens", "output_tokens", "duration_ms", "request"]
    key_kinds = [to_arrow_type(picked.schema[c].dataType) for c in keys]
    schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keys)
    return settle(picked.mapInArrow(work, f"{schema}, {kind_sql}"))


def hash_embed(texts: list[str | None]) -> list[list[float]]:
    """The offline embedding as a provider's call: what ``functions.vectors.hash_embedding`` gives."""
    raw = np.array([list(hashlib.sha256((t or "").encode()).digest()) for t in texts], float).reshape(-1, 32) / 255 - 0.5
    return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).tolist()


def scripted_ranks(scores: dict[str, float] | None = None, script: dict[str, list[int]] | None = None) -> Callable:
    """A reranker by script, as a call over (query, texts): by the texts' scores, else by a query's order of positions, else the reverse order."""

    def call(asked: list[tuple[str, list[str]]]) -> list[list[float]]:
        out = []
        for query, texts in asked:
            if scores is not None:
                out.append([float(scores.get(t, 0.0)) for t in texts])
            else:
                order = (script or {}).get(query, list(range(len(texts)))[::-1])
                place = {k: 1 - 0.01 * p for p, k in enumerate(order)}
                out.append([place.get(k, 0.0) for k in range(len(texts))])
        return out

    return call


def extract_triples(chunks: DataFrame, call: Callable[[list[str]], list], budget: Budget = Budget(rows=16), **options) -> tuple[DataFrame, DataFrame]:
    """Triples of chunks by a model, ``chunk_id, subject, relation, object``, and the chunks that failed, with their errors."""
    kind = "array<struct<subject:string,relation:string,object:string>>"
    found = provided(chunks, call, ["text"], kind, ["chunk_id"], budget=budget, **options)
    triples = found.where("ok").select("chunk_id", F.explode("value").alias("t")).select("chunk_id", "t.subject", "t.relation", "t.object").where("subject is not null and object is not null")
    return triples, found.where("not ok").select("chunk_id", "error")


def scripted_triples(chunks: DataFrame, script: DataFrame) -> DataFrame:
    """Triples of chunks by their text, from a table (text, subject, relation, object): the offline extractor."""
    return chunks.join(script, "text").select("chunk_id", "subject", "relation", "object")
