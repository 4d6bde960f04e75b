"""Removal of repeated runs of lines by winnowing over line hashes.

A window is a span of lines with enough words: the shortest from some line on,
and all longer ones from there that have not enough words without their first
line. Any run of lines with enough words is a union of its windows: the shortest
from each line on as far as they fit, and the one from the last such line to the
run's end. So a run stands earlier just where its windows do, each by itself at
whatever place, and there are at most two windows a line. Of each window the
line with the least hash is selected; equal windows select the same line: a
guaranteed fingerprint. Fingerprints that stand in one place only drop out. At
the others, windows are told apart by the 128-bit hashes of all their lines;
all but the earliest place of a window are deleted. Overlapping windows that match are
what a match extended both ways would cover, at every earlier place at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, column, texts, told_back, without

LEAST_WORDS = 50

#: Bytes of a line's and a window's hash: 128 bits tell apart what 64 would confuse among very many windows.
DIGEST = 16

_POSITION = "doc_id long, th long, fingerprint long, windows array<struct<start:int,end:int,content:binary>>"


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=DIGEST).digest()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: hashes and word counts of its lines that have words."""
    for batch in batches:
        hashes, counts = [], []
        for text in texts(batch):
            own = [(x.strip(), n) for x in (text or b"").split(b"\n") if (n := len(x.split()))]
            hashes.append(b"".join(_digest(x) for x, _ in own))
            counts.append(np.array([n for _, n in own], "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "th"), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "th", "lines", "words"])


def windows_of(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the spans with enough words from each line on: the shortest, and those that would lack words from the next line on."""
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + least).tolist()
    after = [*ends[1:], len(total)]
    return [(s, e) for s, first in enumerate(ends) if first < len(total) for e in range(first, max(first + 1, after[s]))]


def fingerprints(lines: np.ndarray, windows: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Windows by the position selected of them: the least hash, the last of equal ones."""
    out: dict[int, list[tuple[int, int]]] = {}
    for start, end in windows:
        own = lines[start:end]
        at = end - 1 - int(np.argmin(own[::-1]))
        out.setdefault(at, []).append((start, end))
    return out


def _winnow(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "th": [], "fingerprint": [], "windows": []}
            for doc_id, th, lines, words in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "th", "lines", "words")), strict=True):
                hashes = np.frombuffer(lines, "<i8")[:: DIGEST // 8]  # the first half selects, whole digests compare
                for at, own in fingerprints(hashes, windows_of(np.frombuffer(words, "<i4"), least)).items():
                    content = [_digest(lines[DIGEST * s : DIGEST * e]) for s, e in own]
                    out["doc_id"].append(doc_id)
                    out["th"].append(th)
                    out["fingerprint"].append(int(hashes[at]))
                    out["windows"].append([{"start": s, "end": e, "content": c} for (s, e), c in zip(own, content, strict=True)])
            kinds = {"doc_id": pa.int64(), "th": pa.int64(), "fingerprint": pa.int64(), "windows": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("content", pa.binary())]))}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    return run


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, th, runs of every text that has lines to delete; runs count lines that have words, ends excluded."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))
    lines = checkpointed(rows.mapInArrow(_lines, "doc_id long, th long, lines binary, words binary"))
    positions = lines.mapInArrow(_winnow(least_words), _POSITION)
    often = told_back(positions, "fingerprint", ["doc_id", "th"], [F.count("*").alias("n")], "n > 1")
    windows = checkpointed(often.select("doc_id", "th", F.explode("windows").alias("w")).select("doc_id", "th", "w.*"))
    place = F.struct("doc_id", "th", "start")
    met = told_back(windows, "content", ["doc_id", "th", "start"], [F.min(place).alias("first"), F.count("*").alias("n")], "n > 1")
    # the same text's rows are one document: they do not match each other, only its own earlier lines
    later = met.where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("runs"))


def _delete(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, n_gone, words_gone = [], [], [], []
            for text, runs in zip(texts(batch), column(batch, "_runs").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                worded = [i for i, x in enumerate(lines) if x.strip()]
                n_lines.append(len(worded))
                gone = {worded[i] for r in runs or [] for i in range(r["start"], r["end"])}
                n_gone.append(len(gone))
                words_gone.append(sum(len(lines[i].split()) for i in gone))
                out.append(text if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
            made = {"text": pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "words_removed": pa.array(words_gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else column(batch, n) for n in names], names=names)

    return run


def drop_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, all rows, with the text less its repeated runs, and n_lines, n_removed, words_removed.

    A run of lines with least_words words or more that stands at an earlier place
    is deleted: places are ordered by doc_id (null first), text hash and line. Of
    a repeated run the earliest place stays, and every line deleted stands
    earlier too. Lines compare without white space at their ends; blank lines
    part nothing and stay. Rows alike in doc_id and text are one document. Null
    and wordless texts stay as they are. Columns of docs that have one of the new
    names are replaced. An empty table gives no rows.
    """
    docs = without(docs, "n_lines", "n_removed", "words_removed", "_runs", "_id", "_th", "_own")
    runs = repeated_runs(docs, least_words).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("runs").alias("_runs"))
    met = docs.join(runs.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th")), "left").drop("_id", "_th")
    names = [*docs.columns, "n_lines", "n_removed", "words_removed"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return met.mapInArrow(_delete(names), ", ".join([*kinds, "n_lines long", "n_removed long", "words_removed long"]))
