"""A caller's scorer over request rows, with a bounded number of requests in flight in each task."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, wait
from dataclasses import dataclass
from threading import Thread

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Results that wait for an earlier one, for each request in flight: a slow request doesn't stop those after it at once.
_AHEAD = 8


@dataclass(frozen=True)
class Limits:
    """How a task calls its scorer.

    ``in_flight`` requests run at once, of ``batch`` prompts each. A request that raises is tried again ``retries`` times, after
    ``back_off`` seconds, then twice that, and so on; one that takes over ``timeout`` seconds, all its tries together, is given up.
    """

    in_flight: int = 12
    batch: int = 1
    timeout: float = 120.0
    retries: int = 0
    back_off: float = 0.5


def _answers(scorer: Callable, prompts: list[str], limits: Limits, end: float) -> list[tuple[str | None, str]]:
    """(output, status) of each prompt; an exception belongs to the rows of its request."""
    for n in range(limits.retries + 1):
        try:
            said = list(scorer(prompts)) if limits.batch > 1 else [scorer(prompts[0])]
            if len(said) != len(prompts):
                raise ValueError(f"{len(said)} outputs for {len(prompts)} prompts")
            return [(s, "ok") for s in said]
        except Exception as e:  # any client error belongs to its rows
            pause = limits.back_off * 2**n
            if n == limits.retries or time.monotonic() + pause >= end:
                return [(f"[ERROR] {e}", "error")] * len(prompts)
            time.sleep(pause)
    raise AssertionError


def in_order(groups: Iterator[list[str]], scorer: Callable, limits: Limits) -> Iterator[list[tuple[str | None, str]]]:
    """The answers of each group of prompts in the groups' order, with at most ``in_flight`` of them running."""
    order: deque[Future] = deque()
    running: dict[Future, tuple[float, int]] = {}

    def start(prompts: list[str]) -> None:
        own, end = Future(), time.monotonic() + limits.timeout

        def call() -> None:
            got = _answers(scorer, prompts, limits, end)
            if not own.done():
                own.set_result(got)

        order.append(own)
        running[own] = (end, len(prompts))
        # A thread that never returns is left alone when its time is up, and the next request gets one of its own.
        Thread(target=call, daemon=True).start()

    more = True
    while more or order:
        while more and len(running) < limits.in_flight and len(order) < limits.in_flight * _AHEAD:
            prompts = next(groups, None)
            more = prompts is not None
            if more:
                start(prompts)
        if running:
            first_end = min(end for end, _ in running.values())
            done = wait(running, max(0.0, first_end - time.monotonic()), FIRST_COMPLETED).done
            for own in done:
                del running[own]
            now = time.monotonic()
            for own, (_, n) in [(f, x) for f, x in running.items() if x[0] <= now]:
                del running[own]
                if not own.done():
                    own.set_result([(f"[ERROR] no answer in {limits.timeout:g} s", "error")] * n)
        while order and order[0].done():
            yield order.popleft().result()


def infer(requests: DataFrame, scorer_factory: Callable[[], Callable], limits: Limits = Limits(), prompt: str = "prompt") -> DataFrame:
    """Requests with ``output`` and ``status`` (ok or error), in their order; one client a task.

    The scorer takes a prompt, or with ``limits.batch`` over 1 a list of them, and is called from several threads. A null prompt
    is an error row that is not asked for. Memory is a batch of rows and the answers in flight. Responses cost: store the
    result before a second use.
    """
    at = requests.columns.index(prompt)
    names = [*requests.columns, "output", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_factory()
        waiting: deque[tuple[pa.RecordBatch, list[bool]]] = deque()  # rows whose answers are not complete

        def groups() -> Iterator[list[str]]:
            for batch in batches:
                prompts = batch.column(at).to_pylist()
                waiting.append((batch, [p is not None for p in prompts]))
                given = [p for p in prompts if p is not None]
                for i in range(0, len(given), limits.batch):
                    yield given[i : i + limits.batch]

        def complete(batch: pa.RecordBatch, given: list[bool], said: deque) -> pa.RecordBatch:
            rows = [said.popleft() if g else ("[ERROR] no prompt", "error") for g in given]
            columns = [pa.array([None if r[i] is None else str(r[i]) for r in rows], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

        said: deque[tuple[str | None, str]] = deque()
        for answers in in_order(groups(), scorer, limits):
            said.extend(answers)
            while waiting and len(said) >= sum(waiting[0][1]):
                yield complete(*waiting.popleft(), said)
        while waiting:
            yield complete(*waiting.popleft(), said)

    schema = StructType([*requests.schema.fields, StructField("output", StringType()), StructField("status", StringType())])
    return requests.mapInArrow(run, schema)


def load_spread(requests: DataFrame, tasks: int) -> DataFrame:
    """Requests dealt out evenly over ``tasks`` tasks, so that all clients are busy whatever the files' sizes."""
    return requests.repartition(tasks, F.xxhash64(*requests.columns))
