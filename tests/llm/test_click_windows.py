import hashlib
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewatch.llm import click_windows as cw

DATA = "/root/testdata/sf0.001"
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
ORDER = ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]


def brute(rows, batches=12, reach=72, lateness=48):
    """The contract row by row, in plain Python."""
    zero, copies = datetime(1970, 1, 1), []
    text = lambda v: "" if v is None else str(v)
    for r in rows:
        if r["click_id"] is None or r["arrived_at"] is None or r["click_id"] < 0 and r["click_id"] % -3:
            continue
        for j in range(r["click_id"] % 3 + 1 if r["click_id"] >= 0 else 1):
            c = zlib.crc32(f"{r['click_id']}:{j}".encode())
            hour = (r["arrived_at"] - zero) // timedelta(hours=1) + 6 * j * (c % 10)
            cents = None if r["value"] is None else int(np.floor(100 * r["value"] + 0.5))
            micros = None if r["ts"] is None else (r["ts"] - zero) // timedelta(microseconds=1)
            line = "|".join([text(r["client_id"]), text(r["kind"]), text(cents), text(micros), text(r["props"]), str(c % 3)])
            copies.append((hour + c // 10 % 200, r["click_id"], hour, hashlib.sha256(line.encode()).hexdigest()))
    if not copies:
        return []
    low, high = min(copies)[0], max(copies)[0]
    dealt = defaultdict(list)
    for at, key, hour, digest in copies:
        dealt[(at - low) * batches // (high - low + 1)].append((key, hour, digest))
    largest, state, out = None, {}, []
    for b in range(batches):
        for key, hour, digest in sorted(dealt[b]):
            if largest is not None and hour < largest - lateness:
                continue
            own = state.get(key)
            if own is None or hour > own[0] + reach:
                if own:
                    out.append((key, own[0], b, *own[1:]))
                state[key] = [hour, 0, 0, 0, digest]
            else:
                own[1] += 1
                if digest != own[4]:
                    own[2] += 1
                    own[3] += zlib.crc32(digest.encode())
        largest = max([x[1] for x in dealt[b]] + ([largest] if largest is not None else []), default=None)
        for key in [k for k, own in state.items() if b == batches - 1 or largest is not None and own[0] + reach < largest - lateness]:
            own = state.pop(key)
            out.append((key, own[0], b, *own[1:]))
    return sorted(out)


def windows(spark, clicks, batches=cw.BATCHES, **more):
    return sorted(tuple(r) for r in cw.expiring_windows(cw.replayed_copies(clicks, batches), batches, **more).select(ORDER).collect())


def made(spark):
    """Click ids with many rows, ties in time, equal rows, nulls, late rows."""
    rng, base = np.random.default_rng(7), datetime(2024, 2, 1)
    rows = []
    for key in [*range(40), 7, 7, 7]:
        for _ in range(int(rng.integers(1, 8))):
            arrived = base + timedelta(hours=int(rng.integers(0, 900)))
            rows.append((key, arrived - timedelta(seconds=3), arrived, int(rng.integers(0, 3)), [None, "a|b", "view"][int(rng.integers(0, 3))], [None, 1.005, -2.5][int(rng.integers(0, 3))], None if key % 2 else '{"a": 1}'))
    rows += [rows[3]] * 5 + [(5, None, base, None, None, None, None)] * 2 + [(None, base, base, 1, "x", 1.0, ""), (9, base, None, 1, "x", 1.0, ""), (-1, base, base, 1, "x", 1.0, ""), (-3, base, base, 1, "x", 1.0, "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("buckets", "batches"), [(3, 7), (None, 4)])
def test_made_clicks(spark, buckets, batches):
    clicks = made(spark)
    found = windows(spark, clicks, batches, buckets=buckets)
    assert found == brute([r.asDict() for r in clicks.collect()], batches)
    assert len(found) > 60 and any(r[4] for r in found) and {r[2] for r in found} >= {1, batches - 1}


def test_whole_small_table(spark):
    clicks = spark.read.parquet(f"{DATA}/clicks.parquet")
    found = windows(spark, clicks)
    assert found == brute([r.asDict() for r in clicks.collect()])


def test_empty_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert windows(spark, empty) == []
    some = made(spark).where("click_id < 4")
    more = some.select("*", *[F.lit(1).alias(n) for n in ("hour", "hash", "batch", "n", "c", "j", "L", "bucket", "content", "crc", "event")])
    assert windows(spark, more, 2, buckets=2) == brute([r.asDict() for r in some.collect()], 2)


def test_windows_step_by_step():
    segment, hour = np.array([0, 0, 0, 0, 1, 1]), np.array([0, 72, 73, 146, -5, 80])
    assert cw.window_starts(segment, hour, np.array([0, 10]), 72).tolist() == [True, False, True, True, True, False]


def test_batches_without_rows(spark):
    digest = lambda c: hashlib.sha256(c.encode()).digest()
    rows = [(0, 1, 1000, digest("a"), 2), (0, 2, 1500, digest("b"), 1), (3, 2, 1560, digest("c"), 3), (3, 2, 1451, digest("d"), 1), (3, 3, 1700, digest("e"), 1), (3, 4, 1452, digest("f"), 1)]
    got = sorted(tuple(r) for r in cw.expiring_windows(spark.createDataFrame(rows, "batch int, click_id long, hour long, hash binary, n long"), 6, 2).select(ORDER).collect())
    crc = 3 * zlib.crc32(digest("c").hex().encode())
    # click 2's row at 1451 is late; its window is out of reach after batch 3, as is click 4's
    assert got == [(1, 1000, 0, 1, 0, 0, digest("a").hex()), (2, 1500, 3, 3, 3, crc, digest("b").hex()), (3, 1700, 5, 0, 0, 0, digest("e").hex()), (4, 1452, 3, 0, 0, 0, digest("f").hex())]
