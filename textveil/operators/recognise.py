"""Recognisers as functions of Arrow batches: loaded once per Python worker, degrading to no entities where they fail."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.operators.names import ENTITY

NOT_STARTED, LOADING, READY, FAILED = "NOT_STARTED", "LOADING", "READY", "FAILED"


class Null:
    """A recogniser that finds nothing."""

    def recognize(self, text: str) -> list[dict]:
        return []


class Service:
    """A recogniser that is loaded on first use, once. A failure to load is kept: it then finds nothing. A text that it fails on, or takes
    longer than `timeout` seconds for, has no entities and its reason, and the next one is tried: what a row gets doesn't hang on the
    rows before it.

    A recogniser can't be stopped: one that overruns goes on in its thread, and the next text gets a new thread. After MOST_STUCK
    of these the service counts as failed, so that threads don't add up.
    """

    MOST_STUCK = 8

    def __init__(self, loader: Callable[[], object], timeout: float | None = None):
        self.loader, self.timeout = loader, timeout
        self.state, self.reason, self.model, self.stuck = NOT_STARTED, None, None, 0

    def start(self) -> bool:
        if self.state == NOT_STARTED:
            self.state = LOADING
            try:
                self.model, self.state = self.loader(), READY
            except Exception as e:
                self.fail(f"{type(e).__name__}: {e}")
        return self.state == READY

    def fail(self, reason: str) -> None:
        self.state, self.reason = FAILED, reason

    def attempt(self, text: str) -> tuple[list[dict], str | None]:
        """(entities, None), or ([], reason)."""
        if not self.start():
            return [], self.reason
        try:
            return (list(self.model.recognize(text)) if self.timeout is None else self.timed(text)), None
        except TimeoutError:
            self.stuck += 1
            reason = f"TimeoutError: more than {self.timeout:g} s"
            if self.stuck >= self.MOST_STUCK:
                self.fail(reason)
            return [], reason
        except Exception as e:
            return [], f"{type(e).__name__}: {e}"

    def timed(self, text: str) -> list[dict]:
        import queue
        import threading

        got: queue.Queue = queue.Queue()

        def run():
            try:
                got.put((list(self.model.recognize(text)), None))
            except Exception as e:
                got.put((None, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            found, error = got.get(timeout=self.timeout)
        except queue.Empty:
            raise TimeoutError from None
        if error is not None:
            raise error
        return found

    def recognize(self, text: str) -> list[dict]:
        return self.attempt(text)[0]


def enabled(selected: dict[str, bool]) -> bool:
    """Whether a model is worth running: persons or organisations are wanted."""
    return bool(selected.get("PERSON", True) or selected.get("ORG", True))


def recognise(df: DataFrame, loader: Callable[[], object], name: str, text_col: str = "text", strict: bool = False, timeout: float | None = None) -> DataFrame:
    """df with `entities` and `error` (null where the recogniser worked), row by row. strict raises instead, as where a missing model must
    not pass for an empty result. `name` identifies the loaded model in a worker; `timeout` is in seconds a text."""
    kind = f"struct<entities:{ENTITY},error:string>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        import sys

        services = sys.__dict__.setdefault("_textveil_services", {})
        service = services.setdefault((name, timeout), Service(loader, timeout))
        found, errors = [], []
        for t in texts:
            got, error = service.attempt(t) if t else ([], None)
            if strict and error:
                raise RuntimeError(error)
            found.append([{"category": e["category"], "start": e["start"], "end": e["end"], "text": e["text"], "confidence": e.get("confidence"), "model": e.get("model", name)} for e in got])
            errors.append(error)
        return pd.DataFrame({"entities": found, "error": errors})

    return df.withColumn("__r", run(F.col(text_col))).select("*", F.col("__r.entities").alias("entities"), F.col("__r.error").alias("error")).drop("__r")
