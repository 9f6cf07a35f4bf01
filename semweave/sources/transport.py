"""HTTP with retries: same body again after transport errors, 429 and 5xx, with capped, jittered exponential waits."""

from __future__ import annotations

import email.utils
import http.client
import os
import random
import ssl
import time
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

CONNECT_S = 30.0
POLL_S = 0.05


class Interrupted(RuntimeError):
    pass


@dataclass
class Reply:
    status: int
    body: bytes
    retries: int
    micros: int
    headers: dict[str, str] = field(default_factory=dict)
    #: Microseconds of ``micros`` that were spent sending and receiving, not waiting for another try.
    sent: int = 0


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds, or the time until an HTTP date."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def ca_file(setting: str) -> str | None:
    for path in (setting, os.environ.get("SSL_CERT_FILE", ""), "/etc/ssl/cert.pem"):
        if path and os.path.exists(path):
            return path
    return None


class Client:
    """One keep-alive connection to an endpoint."""

    def __init__(self, endpoint: str, timeout: float = 120.0, ca: str = ""):
        self.url = urllib.parse.urlsplit(endpoint)
        self.timeout, self.ca = timeout, ca
        self.connection: http.client.HTTPConnection | None = None

    def connect(self) -> http.client.HTTPConnection:
        if self.connection is None:
            if self.url.scheme == "https":
                context = ssl.create_default_context(cafile=ca_file(self.ca))
                self.connection = http.client.HTTPSConnection(self.url.netloc, timeout=CONNECT_S, context=context)
            else:
                self.connection = http.client.HTTPConnection(self.url.netloc, timeout=CONNECT_S)
            self.connection.connect()
            self.connection.sock.settimeout(self.timeout)
        return self.connection

    def post(self, path: str, body: bytes, headers: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
        try:
            c = self.connect()
            c.request("POST", self.url.path.rstrip("/") + path, body, {"Content-Type": "application/json"} | headers)
            r = c.getresponse()
            return r.status, r.read(), {k.lower(): v for k, v in r.getheaders()}
        except (OSError, http.client.HTTPException):
            self.connection = None
            raise


def post_with_retries(
    send: Callable[[], tuple[int, bytes, dict[str, str]]],
    *,
    max_retries: int,
    max_delay: float,
    after_max: float,
    stopped: Callable[[], bool] = lambda: False,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.time,
    rng: Callable[[], float] = random.random,
) -> Reply:
    """The first reply that isn't worth another try, or the last one; a transport error on the last try is raised."""
    began, tries, sent = clock(), 0, 0.0
    while True:
        wait, start = None, clock()
        try:
            status, body, headers = send()
            sent += clock() - start
            if (status != 429 and status < 500) or tries >= max_retries:
                return Reply(status, body, tries, int((clock() - began) * 1e6), headers, int(sent * 1e6))
            wait = retry_after(headers.get("retry-after"), clock())
        except (OSError, http.client.HTTPException):
            sent += clock() - start
            if tries >= max_retries:
                raise
        back = min(max_delay, 2.0**tries) * (1 - rng() / 2)
        if wait is not None:
            back = max(back, min(wait, after_max))
        tries += 1
        until = clock() + back
        while (left := until - clock()) > 0:
            if stopped():
                raise Interrupted("interrupted while waiting for a retry")
            sleep(min(POLL_S, left))
