import base64
import hashlib
import json
import socket
import struct
import threading

import pytest

from tidewatch.sources import feed

S = feed.SECOND


def messages(n=400):
    """Messages nearly in time order, some at one time, some without a time."""
    out = []
    for i in range(n):
        at = i // 2 * 500_000 + (300_000 if i % 7 == 0 else 0)
        out.append(json.dumps({"time_us": at, "n": i}))
    return out[:50] + ["no json", "[]", json.dumps({"kind": "x"})] + out[50:]


def breaking(sent, after=23, back=2 * S):
    """connect() of a feed that breaks off after some messages, and after a reconnect repeats older ones too."""

    def connect(cursor):
        told = 0
        for text in sent:
            at = feed.message_time(text)
            if at is not None and at < cursor - back:
                continue
            yield text
            told += 1
            if told == after:
                raise ConnectionError("lost")

    return connect


def numbers(rows):
    return [json.loads(text)["n"] for _, text in rows]


def test_span_is_whole_and_single_despite_breaks():
    sent, waits = messages(), []
    got = list(feed.messages_between(breaking(sent), 10 * S, 60 * S, patience=0, sleep=waits.append))
    wanted = [t for t in sent if (at := feed.message_time(t)) is not None and 10 * S <= at < 60 * S]
    assert sorted(numbers(got)) == sorted(json.loads(t)["n"] for t in wanted)
    assert waits and max(waits) <= 60


def test_slices_part_the_messages():
    sent = messages()
    got = [n for at in range(0, 101 * S, 7 * S) for n in numbers(feed.messages_between(breaking(sent, 40), at, at + 7 * S, patience=0, sleep=lambda s: None))]
    assert sorted(got) == list(range(400))


def test_waits_grow_and_the_error_comes_at_last():
    waits = []

    def connect(cursor):
        raise ConnectionError("down")
        yield

    with pytest.raises(ConnectionError):
        list(feed.messages_between(connect, 0, S, first=1, most=8, tries=6, sleep=waits.append))
    assert waits == [1, 2, 4, 8, 8]


def test_quiet_feed_ends_by_patience():
    ticks = iter(range(100))

    def connect(cursor):
        yield json.dumps({"time_us": 5, "n": 0})
        while True:
            yield None

    got = list(feed.messages_between(connect, 0, S, patience=5, clock=lambda: next(ticks)))
    assert numbers(got) == [0]


def test_memory_of_repeats_is_bounded():
    recent = feed.Recent(10)
    assert all(recent.is_new(t, str(t)) for t in range(5000)) and not recent.is_new(4999, "4999")
    assert len(recent.by_time) < 100


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    sent, clock = messages(), tmp_path / "now"
    connect, path = breaking(sent, 60), str(clock)

    def now():
        return int(open(path).read())

    made = lambda: feed.message_feed(connect, now, since=0, name="test_feed", slice_us=9 * S, settle_us=0, batch_us=40 * S, patience=0, first=0)
    for reached in (30, 30, 70, 200):
        clock.write_text(str(reached * S))
        spark.dataSource.register(made())
        stream = spark.readStream.format("test_feed").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema(feed.FEED_SCHEMA).parquet(str(tmp_path / "out")).collect()
        got = sorted(json.loads(r["value"])["n"] for r in rows)
        assert got == sorted(json.loads(t)["n"] for t in sent if (at := feed.message_time(t)) is not None and at < min(reached * S, max(r["time_us"] for r in rows) + 1))
    assert got == list(range(400))


def serve(replies):
    """A websocket service of one connection that sends ready-made frames; gives its port and what it was asked."""
    listener, asked = socket.create_server(("127.0.0.1", 0)), {}

    def run():
        link, _ = listener.accept()
        with link:
            head = b""
            while b"\r\n\r\n" not in head:
                head += link.recv(4096)
            asked["path"] = head.split()[1].decode()
            key = next(x for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key")).split()[1]
            answer = base64.b64encode(hashlib.sha1(key + feed.HANDSHAKE.encode()).digest())
            first, *rest = replies
            link.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + answer + b"\r\n\r\n" + first)
            for r in rest:
                link.sendall(r)
            asked["pong"] = link.recv(4096)

    threading.Thread(target=run, daemon=True).start()
    return listener.getsockname()[1], asked


def frame(body, kind=feed.TEXT, last=True):
    size = bytes([len(body)]) if len(body) < 126 else b"\x7e" + struct.pack(">H", len(body)) if len(body) < 65536 else b"\x7f" + struct.pack(">Q", len(body))
    return bytes([(0x80 if last else 0) | kind]) + size + body


def test_websocket_messages():
    long, huge = "é" * 300, "x" * 70_000
    port, asked = serve([frame(b"first"), frame(b"hi", feed.PING), frame(b"in two ", last=False) + frame(b"parts", 0), frame(long.encode()), frame(huge.encode()), frame(b"", feed.CLOSE)])
    assert list(feed.websocket_feed(f"ws://127.0.0.1:{port}/subscribe?wanted=posts")(42)) == ["first", "in two parts", long, huge]
    assert asked["path"] == "/subscribe?wanted=posts&cursor=42" and asked["pong"][0] & 15 == feed.PONG


def test_no_websocket_there():
    listener = socket.create_server(("127.0.0.1", 0))

    def run():
        link, _ = listener.accept()
        link.recv(4096)
        link.sendall(b"HTTP/1.1 404 Not Found\r\n\r\n")
        link.close()

    threading.Thread(target=run, daemon=True).start()
    with pytest.raises(ConnectionError):
        list(feed.websocket(f"ws://127.0.0.1:{listener.getsockname()[1]}/"))
