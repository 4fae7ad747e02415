"""Asking a remote guard about texts, from the tasks.

The transport can be replaced, so everything but the sockets is tested without a network. A guard that can't
be reached never blocks: its texts count as passed and not judged.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

#: name of the guard that is asked, a parameter of ``Guard``
INPUT_GUARD_NAME = "input_guard"
# Attempts, waits and limits.
ATTEMPTS, FIRST_WAIT, HEALTH_SECONDS, HEALTH_TIMEOUT = 3, 0.5, 60.0, 5.0
VERDICT = "available boolean, passed boolean, validated string, error string, call_id string, latency_ms long"


class Refused(Exception):
    """The guard answered that the request is wrong; asking again doesn't help."""


class Transport(Protocol):
    def __call__(self, url: str, body: str | None, timeout: float) -> str:
        """The answer to a GET (without ``body``) or a POST. Raises Refused for 4xx, anything else for the rest."""


def http(url: str, body: str | None, timeout: float) -> str:
    """Transport over HTTP."""
    request = Request(url, None if body is None else body.encode(), {"Accept": "application/json", "Content-Type": "application/json"})  # noqa: S310
    try:
        with urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode()
    except HTTPError as e:
        raise (Refused if 400 <= e.code < 500 else OSError)(f"HTTP {e.code}") from e


class Guard:
    """One guard behind a URL, with what is known of its health. Each task has its own."""

    def __init__(self, url: str, timeout_ms: int = 2000, name: str = INPUT_GUARD_NAME, transport: Transport = http, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.url, self.name, self.timeout, self.transport = url.rstrip("/"), name, timeout_ms / 1000, transport
        self.attempts, self.wait, self.clock, self.sleep = attempts, wait, clock, sleep
        self.available, self._checked = False, -float("inf")

    def healthy(self) -> bool:
        """Whether the guard can be reached; asked at most once a minute."""
        if self.clock() - self._checked >= HEALTH_SECONDS:
            self._checked = self.clock()
            try:
                json.loads(self.transport(f"{self.url}/health", None, HEALTH_TIMEOUT))
                self.available = True
            except Exception:  # noqa: BLE001
                self.available = False
        return self.available

    def judge(self, text: str) -> dict:
        """The verdict on a text. Failures are tried again with doubled waits, a refusal is not; then the guard counts as down until its next check."""
        began = self.clock()
        verdict = {"available": False, "passed": True, "validated": None, "error": None, "call_id": None, "latency_ms": 0}
        if not self.healthy():
            return verdict
        for k in range(self.attempts):
            if k:
                self.sleep(self.wait * 2 ** (k - 1))
            try:
                a = json.loads(self.transport(f"{self.url}/guards/{quote(self.name, safe='')}/validate", json.dumps({"llmOutput": text, "numReasks": 0}), self.timeout))
                either = lambda x, y, a=a: a.get(x) if a.get(x) is not None else a.get(y)
                verdict.update(available=True, passed=bool(either("validationPassed", "validation_passed")), validated=either("validatedOutput", "validated_output"), error=a.get("error"), call_id=either("callId", "call_id"))
                break
            except Refused as e:
                verdict["error"] = str(e)
                break
            except Exception as e:  # noqa: BLE001
                verdict["error"] = str(e)
        self.available = verdict["available"]
        verdict["latency_ms"] = round((self.clock() - began) * 1000)
        return verdict


def verdicts(df: DataFrame, key: str, text: str, guard: Callable[[], Guard]) -> DataFrame:
    """(key, available, passed, validated, error, call_id, latency_ms) of every row, as ``guard`` of the api takes them.

    Each task makes its own guard. A text that comes again in a batch is asked once; a null text counts as
    empty.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [c.split(" ")[0] for c in VERDICT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = guard()
        for b in batches:
            texts = ["" if t is None else t for t in b[text]]
            known = {t: g.judge(t) for t in dict.fromkeys(texts)}
            yield pd.DataFrame({key: b[key], **{n: [known[t][n] for t in texts] for n in names}})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {VERDICT}")
