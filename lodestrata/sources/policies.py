"""Rate limits and retries of calls to services, with the clock and the sleep as parameters."""

from __future__ import annotations

import email.utils
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from lodestrata.functions.text import tokens_of_literal

# Statuses after which a call is tried again, and what network errors say.
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
NETWORK_WORDS = ("network", "timeout", "timed out", "econnreset", "socket", "dns", "fetch failed")


class RateGate:
    """Lets ``per_minute`` units through a minute; a call waits for the units of those before it."""

    def __init__(self, per_minute: float, now: Callable[[], float] = lambda: time.time() * 1000, sleep: Callable[[float], None] = lambda ms: time.sleep(ms / 1000)):
        self.per_minute, self.now, self.sleep = per_minute, now, sleep
        self._free_at, self._lock = 0.0, Lock()

    def acquire(self, units: float) -> None:
        if not (math.isfinite(units) and units > 0 and math.isfinite(self.per_minute) and self.per_minute > 0):
            return
        with self._lock:
            current = self.now()
            wait = max(self._free_at, current) - current
            self._free_at = current + wait + math.ceil(units / self.per_minute * 60_000)
            if wait > 0:
                self.sleep(wait)


class RateLimiter:
    """Gates for requests and for tokens; 0 means no limit."""

    def __init__(self, rpm: float = 0, tpm: float = 0, **clock):
        self.requests, self.tokens = RateGate(rpm, **clock), RateGate(tpm, **clock)

    def acquire(self, requests: float = 0, tokens: float = 0) -> None:
        self.requests.acquire(requests)
        self.tokens.acquire(tokens)


def retry_after_ms(value: str | None, now_ms: float) -> float | None:
    """Milliseconds that a Retry-After header asks for, as seconds or as a date; null if it says neither."""
    if not value:
        return None
    head = value.strip()
    digits = head[: len(head) - len(head.lstrip("0123456789"))]
    if digits:
        return int(digits) * 1000.0
    try:
        return max(0.0, email.utils.parsedate_to_datetime(head).timestamp() * 1000 - now_ms)
    except (TypeError, ValueError):
        return None


def retry_delay_ms(status: int | None, after_ms: float | None, base_ms: float) -> float:
    """A refused rate waits twice the base at least."""
    base, after = max(0.0, base_ms), max(0.0, after_ms or 0.0)
    return max(after, 2 * base if status == 429 else base)


def retryable_error(error: BaseException) -> bool:
    if isinstance(error, (TimeoutError, ConnectionError)):
        return True
    said = str(error).lower()
    return any(w in said for w in NETWORK_WORDS)


@dataclass
class Response:
    status: int
    body: str = ""
    headers: dict[str, str] = field(default_factory=dict)


Fetch = Callable[[str, str], Response]


def with_policies(fetch: Fetch, *, rpm: float = 0, tpm: float = 0, retries: int = 3, delay_seconds: float = 10, now=lambda: time.time() * 1000, sleep=lambda ms: time.sleep(ms / 1000)) -> Fetch:
    """``fetch`` (url, body) behind a rate limiter, tried again after retryable statuses and network errors.

    Once a rate was refused two more attempts are allowed than before, once a call.
    """
    limiter = RateLimiter(rpm, tpm, now=now, sleep=sleep)

    def call(url: str, body: str = "") -> Response:
        allowed, refused, attempt = retries, False, 0
        while True:
            limiter.acquire(requests=1, tokens=tokens_of_literal(body) if body else 0)
            error, response = None, None
            try:
                response = fetch(url, body)
            except Exception as e:  # noqa: BLE001 - judged below
                if not retryable_error(e):
                    raise
                error = e
            if response is not None and response.status not in RETRYABLE:
                return response
            if response is not None and response.status == 429 and not refused:
                allowed, refused = allowed + 2, True
            if attempt >= allowed:
                if error is not None:
                    raise error
                return response
            after = retry_after_ms(response.headers.get("retry-after"), now()) if response is not None else None
            sleep(retry_delay_ms(response.status if response is not None else None, after, delay_seconds * 1000))
            attempt += 1

    return call
