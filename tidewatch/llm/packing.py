"""Best-fit packing of documents into token sequences by sum of squares.

Texts are tokenized where they lie and cut into pieces of at most a sequence's
length; only pieces shorter than that need packing. Each goes where the squared
counts of open sequences per residual gap sum to the least, which keeps any gap
from piling up. A task packs what it has read, in blocks of bounded size; a block
leaves a few sequences partly filled, more of them the less a task has read. The
pieces of those (narrow rows, no ids) are gathered in as few blocks as they fill
and packed once more, so the number of sequences hardly depends on how rows lie.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, column, per_worker, slices, texts

SEQUENCE = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
BLOCK_PIECES = 400_000
CACHE_PARTS = 1_200_000
PARTS_AT_ONCE = 60
MARK = "\x00"
CLOSERS = b".,!;:|#*$%&"
BATCH_ROWS = 500

#: A sequence that lacks more than this part of its tokens is packed once more.
GAP_PART = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    """Ids of whole texts, from those of their white-space parts.

    The tokenizer drops white space and no token spans it, so a text's ids are
    those of its parts in turn; parts recur, and each is encoded once while the
    cache lasts. Unknown parts are encoded many at a time, parted by a character
    that is a token of its own. Texts that could hold a special token are not
    lower-cased first.
    """

    def __init__(self, path: str, most: int = CACHE_PARTS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_file(path), {}, most
        mark = self.encode([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None

    def encode(self, some: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, parts: list[bytes]) -> None:
        known, mark = self.known, MARK.encode()
        alone = parts if self.mark is None else [w for w in parts if mark in w]
        for w, ids in zip(alone, self.encode([w.decode("utf-8") for w in alone]), strict=True):
            known[w] = np.array(ids, "<u4").tobytes()
        rest = [] if self.mark is None else [w for w in parts if mark not in w]
        between = b" " + mark + b" "
        groups = [rest[at : at + PARTS_AT_ONCE] for at in range(0, len(rest), PARTS_AT_ONCE)]
        for group, ids in zip(groups, self.encode([between.join(g).decode("utf-8") for g in groups]), strict=True):
            ids = np.array(ids, "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            ids, start = ids.tobytes(), 0
            for w, end in zip(group, [*ends, len(ids) // 4], strict=True):
                known[w] = ids[4 * start : 4 * end]
                start = end + 1

    def learn_all(self, new: set[bytes]) -> None:
        """Learn parts, those that end in punctuation by their two halves."""
        known = self.known
        halves, apart = {}, set()
        for w in new:
            base = w.rstrip(CLOSERS)
            if base != w and base[-1:].isalnum():  # an ASCII letter or digit: the punctuation is a token's start
                halves[w] = base, w[len(base) :]
                apart.update(halves[w])
            else:
                apart.add(w)
        self.learn([w for w in apart if w not in known])
        for w, (base, end) in halves.items():
            known[w] = known[base] + known[end]

    def __call__(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, without an end."""
        known = self.known
        words = ((text if b"<|" in text else text.lower()).split()) if text else []
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > self.most:
                known.clear()
            gaps = [i for i, x in enumerate(ids) if x is None]
            self.learn_all({words[i] for i in gaps})
            for i in gaps:
                ids[i] = known[words[i]]
        return b"".join(ids)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, taken from the largest to the smallest.

    With N(h) open bins filled to h, that open bin is chosen which makes the sum
    of N(h)**2 smallest; of equal ones the fullest. A bin is opened only when none
    has room. Sizes lie in 1..capacity-1.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_bins = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        have = count[1 : capacity - s + 1]
        change = 2 * (count[s + 1 :] - have) + 2
        change[-1] = 1 - 2 * have[-1]
        change[have == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # from the fullest
        if have[best]:
            level = best + 1
            b = open_at[level].pop()
            count[level] -= 1
        else:
            level, b = 0, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, level
        if level + s < capacity:
            count[level + s] += 1
            open_at[level + s].append(b)
    return bins, offsets


def place(rows: list[tuple], capacity: int) -> list[np.ndarray]:
    """(sequence, offset, gap of the sequence) of pieces (doc_id, piece, start, length, crc), sequences numbered from 0."""
    length = np.array([r[3] for r in rows], np.int64)
    ids, offset = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
    full = length == capacity
    short = np.flatnonzero(~full)
    ids[short], offset[short] = sum_of_squares(length[short], capacity)
    n = int(ids[short].max()) + 1 if len(short) else 0
    ids[full] = n + np.arange(int(full.sum()))
    return [ids, offset, (capacity - np.bincount(ids, length)[ids]).astype(np.int64)]


def _placed(rows: list[tuple], capacity: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces with their places, and the next free sequence number."""
    ids, offset, gap = place(rows, capacity)
    own = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
    batch = pa.RecordBatch.from_arrays([*own, pa.array(ids + sequence), pa.array(offset), pa.array(gap)], names=[*NAMES, "gap"])
    return batch, sequence + int(ids.max()) + 1


def _first_number(again: int) -> int:
    """Sequence numbers of tasks and rounds do not meet."""
    return again << 62 | TaskContext.get().partitionId() << 36


def _pack(path: str, capacity: int, block: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(f"tokenizer {path} {cache}", lambda: CachedTokenizer(path, cache))
        sequence = _first_number(0)
        end = np.array([END_ID], "<u4").tobytes()
        rows: list[tuple] = []
        for batch in slices(batches, BATCH_ROWS):
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), map(encode, texts(batch)), strict=True):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    own = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, k, at, len(own) // 4, zlib.crc32(own)))
            if len(rows) >= block:
                out, sequence = _placed(rows, capacity, sequence)
                yield out
                rows = []
        if rows:
            yield _placed(rows, capacity, sequence)[0]

    return run


def _pack_again(capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rows = _first_number(1), []
        for batch in slices(batches, block):
            rows += zip(*(column(batch, c).to_pylist() for c in NAMES[:5]), strict=True)
            if len(rows) >= block:
                out, sequence = _placed(rows, capacity, sequence)
                yield out
                rows = []
        if rows:
            yield _placed(rows, capacity, sequence)[0]

    return run


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE, block: int = BLOCK_PIECES, cache: int = CACHE_PARTS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and an end id; a null or empty text is the end
    id alone. Only longer documents than a sequence are cut. A repeated row is
    packed again; a null doc_id stays null. An empty table gives no rows. Columns
    other than doc_id and text are not read. A worker keeps the ids of at most about
    `cache` parts, some 150 bytes each; fewer cost time, not results. Sequences
    that lack more than capacity / GAP_PART tokens are packed a second time, in
    blocks of `block` pieces; the first round is cut off by a checkpoint, so texts
    are encoded once.
    """
    kinds = f"{PIECES}, gap long"
    first = checkpointed(docs.select("doc_id", "text").mapInArrow(_pack(path or tokenizer_path(), capacity, block, cache), kinds))
    partly = first.where(F.col("gap") > capacity // GAP_PART)
    blocks = max(1, -(-partly.count() // block))
    again = partly.select(*NAMES[:5]).repartition(blocks).mapInArrow(_pack_again(capacity, block), kinds)
    return first.where(F.col("gap") <= capacity // GAP_PART).unionByName(again).drop("gap")
