"""Providers: model calls and page readers as batch functions behind one interface, with a lookup for tests.

A provider turns a batch of inputs into a batch of rows; a call that fails gives a row with status failed and the error's
text, never an exception that ends the job. Concurrency is the number of partitions of the stage.
"""

from __future__ import annotations

import json
import random
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Provider(ABC):
    """One call per input text or path."""

    @abstractmethod
    def call(self, key: str) -> dict: ...


class Lookup(Provider):
    """Answers from a mapping; for tests and replays."""

    def __init__(self, answers: dict[str, dict]):
        self.answers = answers

    def call(self, key: str) -> dict:
        return self.answers[key]


_REGISTRY: dict[str, Callable[..., Provider]] = {"lookup": Lookup}


def register(name: str, make: Callable[..., Provider]) -> None:
    _REGISTRY[name] = make


def create(name: str, **settings) -> Provider:
    if name not in _REGISTRY:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**settings)


#: Errors of a connection, not of the request.
TRANSIENT_ERRORS = ("RemoteProtocolError", "ConnectError", "ReadTimeout", "WriteTimeout", "ConnectTimeout", "PoolTimeout")
TRANSIENT_WORDS = ("server disconnected", "connection reset", "temporarily unavailable", "unavailable", "timed out", "timeout")


def is_transient(error: BaseException) -> bool:
    return type(error).__name__ in TRANSIENT_ERRORS or any(w in str(error).lower() for w in TRANSIENT_WORDS)


def delay_seconds(attempt: int, base: float, transient: bool, jitter: float = 0.0) -> float:
    """Wait after attempt 0, 1, ...: doubling, three times as long for a lost connection; jitter (0 to 1) adds up to a quarter, 5 s at most."""
    wait = base * 2**attempt * (3 if transient else 1)
    return wait + jitter * min(0.25 * wait, 5.0)


def answers(inputs: DataFrame, key: str, provider: Provider, concurrency: int, retries: int = 3, base_delay: float = 1.0) -> DataFrame:
    """key, status (ok, failed), attempts, waited seconds, answer (JSON) or error. Null keys fail without a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in b[key]:
                error, attempt, waited = "no input", 0, 0.0
                for attempt in range(1, retries + 2) if k is not None else ():
                    try:
                        out.append((k, "ok", attempt, waited, json.dumps(provider.call(k), sort_keys=True), None))
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a call is a row
                        error = f"{type(e).__name__}: {e}"
                        if attempt <= retries:
                            wait = delay_seconds(attempt - 1, base_delay, is_transient(e), random.random())
                            time.sleep(wait)
                            waited += wait
                else:
                    out.append((k, "failed", attempt, waited, None, error))
            yield pd.DataFrame(out, columns=[key, "status", "attempts", "waited", "answer", "error"])

    return inputs.select(key).repartition(concurrency).mapInPandas(run, f"`{key}` string, status string, attempts int, waited double, answer string, error string")


def usage(payload: Column, model: Column) -> Column:
    """struct<input_tokens, output_tokens, total_tokens, cached_tokens, model> of a call's usage as JSON, by whichever names it
    counts under; missing, null and zero counts fall back to the next name, a missing total to the sum. No payload is all zero."""
    n = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{p}").try_cast("bigint"), F.lit(0)) for p in paths], F.lit(0).cast("bigint"))
    given, made = n("prompt_token_count", "input_tokens"), n("candidates_token_count", "output_tokens")
    total = n("total_token_count", "total_tokens")
    # One interface states its total itself, the other may leave it out.
    counted_otherwise = F.get_json_object(payload, "$.prompt_token_count").isNotNull() | F.get_json_object(payload, "$.candidates_token_count").isNotNull()
    cached = n("cached_content_token_count", "input_tokens_details.cached_tokens", "cached_input_tokens")
    return F.struct(given.alias("input_tokens"), made.alias("output_tokens"), F.when(counted_otherwise & (total == 0), given + made).otherwise(total).alias("total_tokens"), cached.alias("cached_tokens"), model.alias("model"))
