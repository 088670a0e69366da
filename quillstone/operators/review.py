"""Review of candidates by an outside reviewer, and adapters for recognition services.

Clients are passed in; nothing here opens a connection.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVIEW = "is_garbled boolean, confidence double, category string, suspicious_span string, reason string, needs_source_ocr boolean"
ATTEMPTS, LONGEST_WAIT = 8, 8


class RecognitionBackend(Protocol):
    """A service that turns a chunk of a scanned book into pages."""

    def submit(self, chunk: bytes) -> str: ...

    def poll(self, job: str) -> tuple[str, str | None]:
        """(state, place of the result); states ``done`` and ``failed`` are final."""
        ...

    def fetch(self, place: str) -> dict: ...


def is_transient(error: str) -> bool:
    """No answer and transport errors are worth another attempt; malformed answers are not."""
    return not error or error == "no response" or error.startswith("HTTP error:")


def parse_answer(text: str) -> dict:
    """The JSON object of an answer, fenced or not; {"error": …} where there is none."""
    m = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    try:
        return json.loads(m[1] if m else text)
    except json.JSONDecodeError:
        return {"error": f"invalid JSON: {text[:200]}"}


def ask(client: Callable[[dict], dict | None], candidate: dict, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, str | None]:
    """(review, None) or (None, error) after at most ``attempts`` transient errors with waits of 1, 2, 4, … seconds."""
    error = "no response"
    for k in range(max(1, attempts)):
        answer = client(candidate)
        if answer is not None and "error" not in answer:
            return answer, None
        error = answer["error"] if answer else "no response"
        if not is_transient(error):
            break
        if k < attempts - 1:
            sleep(min(2**k, LONGEST_WAIT))
    return None, error


def review(candidates: DataFrame, client: Callable[[dict], dict | None], strict: bool = False, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``candidates`` with ``review`` (a struct of REVIEW) or ``error``; ``strict`` raises at the first error.

    The client is called in tasks, once a candidate and attempt, so a rerun task asks again.
    """
    columns = candidates.columns
    names = [x.split()[0] for x in REVIEW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                found, error = ask(client, record, attempts, sleep)
                if error and strict:
                    raise RuntimeError(f"review failed: {error}")
                rows.append({**record, "review": json.dumps(found) if found else None, "error": error})
            yield pd.DataFrame(rows, columns=[*columns, "review", "error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    out = candidates.mapInPandas(run, f"{ddl}, review string, error string")
    parsed = F.from_json("review", REVIEW)
    return out.withColumn("review", F.when(F.col("review").isNotNull(), F.struct(*[parsed.getField(n).alias(n) for n in names])))


def wait_for(backend: RecognitionBackend, chunk: bytes, interval: float = 5, longest: float = 1800, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict:
    """Submit a chunk, poll until it is done, and fetch the result; RuntimeError on failure, TimeoutError when it takes too long."""
    job, began = backend.submit(chunk), clock()
    while clock() - began <= longest:
        state, place = backend.poll(job)
        if state == "done" and place:
            return fetch_with_retry(backend, place, sleep=sleep)
        if state == "failed":
            raise RuntimeError(f"job {job} failed")
        sleep(interval)
    raise TimeoutError(f"job {job} took more than {longest} s")


def fetch_with_retry(backend: RecognitionBackend, place: str, waits: tuple[float, ...] = (0, 5, 10, 20, 40), sleep: Callable[[float], None] = time.sleep) -> dict:
    last: Exception | None = None
    for wait in waits:
        if wait:
            sleep(wait)
        try:
            return backend.fetch(place)
        except OSError as e:
            last = e
    raise RuntimeError(f"result could not be fetched: {last}")
