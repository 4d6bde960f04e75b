"""Push feeds with a time cursor as replayable streaming sources.

A feed sends messages in the order of their time, nearly, from a cursor that the
reader names when it connects; it may break off, and after a reconnect repeat
what it had sent. The stream's offset is such a time. A micro-batch is a span of
time, dealt in slices; each slice's task connects with the slice's start as
cursor and leaves when messages pass its end, so nothing goes through the
driver, and a span that is read again after a failure gives the same messages.
A message belongs to the slice that its own time lies in.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SECOND = 1_000_000
FEED_SCHEMA = "time_us long, value string"


def message_time(text: str) -> int | None:
    """The time of a JSON message, in microseconds; None if it has none."""
    try:
        got = json.loads(text)
        return int(got["time_us"]) if isinstance(got, dict) and got.get("time_us") is not None else None
    except (ValueError, TypeError):
        return None


class Recent:
    """Messages of the last stretch of time, by digest, to know repeats after a reconnect."""

    def __init__(self, stretch: int) -> None:
        self.stretch, self.newest, self.by_time = stretch, -1, {}

    def is_new(self, at: int, text: str) -> bool:
        if at > self.newest:
            self.newest = at
            if len(self.by_time) > 64:
                self.by_time = {t: own for t, own in self.by_time.items() if t >= at - self.stretch}
        own, digest = self.by_time.setdefault(at, set()), hashlib.blake2b(text.encode(), digest_size=12).digest()
        if digest in own:
            return False
        own.add(digest)
        return True


def messages_between(
    connect: Callable[[int], Iterator[str | None]], start: int, end: int, disorder: int = SECOND, patience: float = 30.0, first: float = 1.0, most: float = 60.0, tries: int = 12, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic
) -> Iterator[tuple[int, str]]:
    """(time, message) of a feed with start <= time < end, each once.

    connect(cursor) yields messages from about that time on, None where the feed is
    idle, and ends or raises OSError where it breaks off. After a break the reader
    waits (first, doubled up to most seconds) and goes on from the newest time
    seen, less `disorder`: by so much a message may come later than a newer one.
    A span ends with a message beyond its end by more than that, or after
    `patience` seconds without a message, since a quiet feed shows no end. Breaks
    without a new message between them are counted; after `tries` the error is
    raised, and Spark's own retry of the task reads the same span again.
    """
    recent, broken, heard = Recent(2 * disorder), 0, clock()
    while True:
        cursor = max(start, recent.newest) - disorder
        try:
            for text in connect(cursor):
                if text is None:
                    if clock() - heard >= patience:
                        return
                    continue
                at = message_time(text)
                if at is None:
                    continue
                if at >= end + disorder:
                    return
                heard = clock()
                broken = 0 if at > max(start, recent.newest) else broken
                if at >= cursor and recent.is_new(at, text) and start <= at < end:
                    yield at, text
            if clock() - heard >= patience:
                return
            raise ConnectionError("the feed ended the connection")
        except OSError:
            broken += 1
            if broken >= tries:
                raise
            sleep(min(most, first * 2 ** (broken - 1)))


def message_feed(
    connect: Callable[[int], Iterator[str | None]], now: Callable[[], int] = lambda: time.time_ns() // 1000, since: int | None = None, name: str = "message_feed", slice_us: int = 60 * SECOND, settle_us: int = 2 * SECOND, batch_us: int = 3600 * SECOND, **reading
) -> type[DataSource]:
    """A streaming source of a feed: spark.dataSource.register(it), then spark.readStream.format(name).load().

    Rows have the message's time and text. The stream begins at `since`, or now, and
    goes up to `now` less settle_us, by when what was sent has arrived. A
    micro-batch takes batch_us at most, the first one after a restart all that was
    missed; a task takes slice_us, which bounds what it reads. Each slice opens a
    connection of its own; a feed that allows one reader needs slices as long
    as batches. reading: further settings of messages_between.
    """

    class Reader(DataSourceStreamReader):
        reached: int | None = None

        def initialOffset(self) -> dict:
            self.reached = now() - settle_us if since is None else since
            return {"time_us": self.reached}

        def latestOffset(self) -> dict:
            newest = now() - settle_us
            return {"time_us": newest if self.reached is None else max(self.reached, min(newest, self.reached + batch_us))}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            low, high = start["time_us"], end["time_us"]
            self.reached = high
            return [InputPartition((at, min(high, at + slice_us))) for at in range(low, high, slice_us)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from messages_between(connect, *partition.value, **reading)

        def commit(self, end: dict) -> None:
            self.reached = max(self.reached or 0, end["time_us"])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FEED_SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader()

    return Source


#: Kinds of frames of RFC 6455 and the constant of its handshake; fixed values.
TEXT, CLOSE, PING, PONG = 1, 8, 9, 10
HANDSHAKE = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


def websocket(url: str, timeout: float = 10.0) -> Iterator[str | None]:
    """Text messages that a websocket service pushes; None when none came for `timeout` seconds. Raises OSError where the connection fails."""
    where = urlsplit(url)
    secure = where.scheme == "wss"
    port = where.port or (443 if secure else 80)
    with socket.create_connection((where.hostname, port), timeout) as plain:
        link = ssl.create_default_context().wrap_socket(plain, server_hostname=where.hostname) if secure else plain
        key = base64.b64encode(os.urandom(16)).decode()
        path = (where.path or "/") + (f"?{where.query}" if where.query else "")
        link.sendall(f"GET {path} HTTP/1.1\r\nHost: {where.hostname}:{port}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        held = bytearray()

        def more() -> None:
            if not (got := link.recv(1 << 16)):
                raise ConnectionError("the connection was closed")
            held.extend(got)

        def take(n: int) -> bytes:
            while len(held) < n:
                more()
            out = bytes(held[:n])
            del held[:n]
            return out

        while b"\r\n\r\n" not in held:
            more()
        head = take(held.index(b"\r\n\r\n") + 4)
        wanted = base64.b64encode(hashlib.sha1((key + HANDSHAKE).encode()).digest())
        if b" 101 " not in head.split(b"\r\n")[0] or wanted not in head:
            raise ConnectionError("no websocket at this address")
        parts = b""
        while True:
            try:
                take_head = take(2)
            except TimeoutError:
                yield None
                continue
            kind, size = take_head[0] & 15, take_head[1] & 127
            size = struct.unpack(">H", take(2))[0] if size == 126 else struct.unpack(">Q", take(8))[0] if size == 127 else size
            body = take(size)
            if kind == CLOSE:
                return
            if kind == PING:
                mask = os.urandom(4)
                link.sendall(bytes([0x80 | PONG, 0x80 | len(body)]) + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(body)))
            elif kind <= 2:
                parts += body
                if take_head[0] & 0x80:
                    yield parts.decode("utf-8", "replace")
                    parts = b""


def websocket_feed(url: str) -> Callable[[int], Iterator[str | None]]:
    """connect() of a websocket service that takes its cursor (microseconds) as a parameter of the address."""

    def connect(cursor: int) -> Iterator[str | None]:
        return websocket(f"{url}{'&' if '?' in url else '?'}cursor={cursor}")

    return connect
