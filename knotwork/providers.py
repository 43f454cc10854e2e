"""Hooks for language and embedding models, with deterministic offline defaults."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Completer(Protocol):
    def __call__(self, prompt: str, system: str | None = None, history: list[str] | None = None) -> str: ...


def offline_completer(prompt: str, system: str | None = None, history: list[str] | None = None) -> str:
    """The first sentence of the prompt."""
    return prompt.split(". ")[0].strip()


@dataclass
class Rotation:
    """Several completers in turn; one that fails is left out for a while, and each call is tried anew a number of times."""

    completers: list[Callable[..., str]]
    attempts: int = 3
    rest: float = 60.0
    wait: float = 0.0
    _next: int = 0
    _until: dict[int, float] = field(default_factory=dict)

    def __call__(self, prompt: str, system: str | None = None, history: list[str] | None = None) -> str:
        last: Exception | None = None
        for attempt in range(self.attempts):
            for step in range(len(self.completers)):
                i = (self._next + step) % len(self.completers)
                if self._until.get(i, 0) > time.monotonic():
                    continue
                self._next = i + 1
                try:
                    return self.completers[i](prompt, system, history)
                except Exception as e:  # a provider's errors are its own
                    last = e
                    self._until[i] = time.monotonic() + self.rest
            time.sleep(self.wait * 2**attempt)
            self._until.clear()
        raise RuntimeError("no provider answered") from last


@dataclass
class Limited:
    """A completer that at most `at_once` threads of a worker call at a time; the others wait for their turn."""

    completer: Callable[..., str]
    at_once: int = 4
    _turns: threading.Semaphore | None = None

    def __post_init__(self):
        self._turns = threading.Semaphore(self.at_once)

    def __call__(self, prompt: str, system: str | None = None, history: list[str] | None = None) -> str:
        with self._turns:
            return self.completer(prompt, system, history)

    def __reduce__(self):  # a semaphore stays with its worker
        return Limited, (self.completer, self.at_once)


class Streamer(Protocol):
    """A provider that gives its answer in pieces as they come."""

    def __call__(self, prompt: str, system: str | None = None) -> Iterator[str]: ...


def converted(text: str, convert: Callable[[str], object] | None = None) -> object | None:
    """An answer as JSON: as it is, else through the provider's own converter, else None."""
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        if convert is None:
            return None
        try:
            return convert(text)
        except Exception:  # noqa: BLE001 - a converter's errors are its own
            return None


def events(meta: dict, pieces: Callable[[], Iterator[str]]) -> Iterator[str]:
    """Server-sent events of an answer: meta, one token event a piece, done; an error ends the stream with an error event."""
    line = lambda name, data: f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"
    yield line("meta", meta)
    try:
        for piece in pieces():
            yield line("token", {"text": piece})
    except Exception as e:  # noqa: BLE001 - the reader of the stream is told
        yield line("error", {"message": f"{type(e).__name__}: {e}"})
        return
    yield line("done", {"success": True})


def streamed(mode: str, prompt: str, streamer: Streamer | None = None, completer: Completer = offline_completer, cached: str | None = None) -> Iterator[str]:
    """The pieces of an answer in a mode that streams: a cached answer replayed, else the provider's own pieces, else its finished answer cut."""
    if mode not in STREAMING:
        raise ValueError(f"mode {mode!r} does not stream; one of {STREAMING}")
    if cached is not None:
        yield from stream_text(cached)
    elif streamer is not None:
        yield from streamer(prompt)
    else:
        yield from stream_text(completer(prompt))


STREAMING = ("hyper", "hyper-lite", "naive", "llm")


def complete(df: DataFrame, prompt: str, make: Callable[[], Completer], column: str = "answer") -> DataFrame:
    """Adds the completion of each row's prompt; `make` builds a provider once in each task. Null prompts stay null."""
    schema = StructType([*df.schema.fields, StructField(column, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            batch[column] = [None if p is None else provider(p) for p in batch[prompt]]
            yield batch

    return df.mapInPandas(run, schema)


def cached_complete(df: DataFrame, prompt: str, cache: DataFrame, make: Callable[[], Completer], model: str = "offline") -> tuple[DataFrame, DataFrame]:
    """(answered rows, new cache rows): cached prompts are not asked again, equal prompts once."""
    keyed = df.withColumn("args_hash", F.md5(F.concat_ws("\u0001", F.lit(model), prompt)))
    asked = keyed.select("args_hash", prompt).where(F.col(prompt).isNotNull()).dropDuplicates(["args_hash"]).join(cache.select("args_hash"), "args_hash", "left_anti")
    from knotwork.session import durable

    new = durable(complete(asked, prompt, make).select("args_hash", "answer"))
    known = cache.select("args_hash", "answer").unionByName(new)
    return keyed.join(known, "args_hash", "left").drop("args_hash"), new


def stream_text(text: str, width: int = 32) -> Iterator[str]:
    """A finished answer as a stream of pieces."""
    for i in range(0, len(text), width):
        yield text[i : i + width]
