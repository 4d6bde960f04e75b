"""Vectors of words and texts learned from the corpus itself.

Words that stand near each other more often than chance are close: the matrix of
positive pointwise mutual information of word pairs, cut to its main axes by a
randomised range finder. The matrix is sparse and lives in Spark as cells: pair
counts of a strip of words by a block of words, packed and compressed, a strip's
cells in one partition. Information is worked out from the counts where a cell is
read. Dense factors, a small vector per word, are files of the shared folder, one
for each block; a task that multiplies a strip reads them one after another, so
neither the matrix nor a factor is shuffled or copied for a product. Vocabulary and
word vectors are looked up in such files too, piece by piece. Only matrices of axes
by axes come to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.checkpoints import checkpointed, shared_folder
from tidewatch.functions.text import tokens

#: Axes kept, further ones that sharpen them, multiplications that do so too.
SIZE, EXTRA, POWERS = 64, 16, 3
#: Words apart that still count as near; texts that a word is in, at least; strips of a matrix, about, and their words at least.
REACH, LEAST_TEXTS, STRIPS, LEAST_WORDS = 5, 3, 32, 256
#: Pairs that a task holds before it sums them; entries of a row that are few; words of texts weighed at once; rows of a file held at once.
PAIRS_HELD, FEW, ENTRIES, FILE_ROWS = 4_000_000, 12, 20_000, 65_536
#: Smoothing of a text's words: rare ones count for more.
SMOOTH = 1e-3


def _written(df: DataFrame, by: str | None = None) -> str:
    """Where df now lies as Parquet in the shared folder; with `by`, a folder for each of its values."""
    path = f"{shared_folder(df.sparkSession)}/vectors-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "none" if by else "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def _dropped(path: str) -> None:
    """Remove a table that _written made and nothing reads any more."""
    files, root = pa.fs.FileSystem.from_uri(path)
    files.delete_dir(root)


def _pieces(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Some columns of a Parquet folder, FILE_ROWS rows at a time; nothing where there is none."""
    files, root = pa.fs.FileSystem.from_uri(path)
    found = files.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with files.open_input_file(name) as file:
            yield from pa.parquet.ParquetFile(file).iter_batches(FILE_ROWS, columns=columns)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, which hold much each, one after another."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _words_of(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word's text, its place among the distinct ones) of a batch of word lists."""
    held = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
    return held.dictionary, text, held.indices.to_numpy()


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's work: token, n and texts with it, of each batch of word lists."""
    for batch in batches:
        names, text, word = _words_of(batch.column(0))
        texts = np.unique(text * max(len(names), 1) + word) % max(len(names), 1)
        yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(word, minlength=len(names))), pa.array(np.bincount(texts, minlength=len(names)))], names=["token", "n", "texts"])


def known_words(texts: DataFrame, text: Column, least: int = LEAST_TEXTS) -> tuple[str, int]:
    """(where token, i, n of words in `least` texts or more lie, their number); each row of texts is a text.

    Words are numbered by spelling, span by span, so no task orders all of them.
    """
    counts = texts.select(tokens(text).alias("words")).mapInArrow(_counted_words, "token string, n long, texts long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).where(F.col("texts") >= least).drop("texts")
    counts = checkpointed(counts.repartitionByRange("token").sortWithinPartitions("token").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    spans = counts.groupBy("_part").agg(F.count("*").alias("_n")).orderBy("_part").collect()  # a row for each span
    firsts, total = [], 0
    for r in spans:
        firsts.append((r["_part"], total))
        total += r["_n"]
    first = texts.sparkSession.createDataFrame(firsts, "_part int, _first long")
    return _written(counts.join(F.broadcast(first), "_part").select("token", (F.col("_first") + F.col("_at")).alias("i"), "n")), total


def _lines(words: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: line, the numbers of a text's known words in order, of its word lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, text, word = _words_of(batch.column(0))
            number = np.full(len(names), -1, np.int64)
            for piece in _pieces(words, ["token", "i"]):
                at = pa.compute.index_in(names, piece.column(0)).fill_null(-1).to_numpy()
                number[at >= 0] = piece.column(1).to_numpy()[at[at >= 0]]
            flat = number[word]
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[flat >= 0], minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[flat >= 0]))], names=["line"])

    return run


def near_pairs(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: (code, n) of numbers below 2^31 that stand within `reach` in its lines, the lower one in a code's upper half, summed over some PAIRS_HELD pairs."""

    def counted(codes: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0
        for batch in batches:
            lines = batch.column(0)
            flat = lines.flatten().to_numpy()
            line = np.repeat(np.arange(len(lines)), pa.compute.list_value_length(lines).to_numpy())
            for apart in range(1, reach + 1):
                for at in range(0, max(len(flat) - apart, 0), PAIRS_HELD):
                    own = slice(at, min(at + PAIRS_HELD, len(flat) - apart))
                    other = slice(own.start + apart, own.stop + apart)
                    same = line[own] == line[other]
                    a, b = flat[own][same], flat[other][same]
                    codes.append(np.minimum(a, b) << 32 | np.maximum(a, b))
                    held += len(a)
                    if held >= PAIRS_HELD:
                        yield counted(codes)
                        codes, held = [], 0
        if held:
            yield counted(codes)

    return run


_CELL = "strip int, block int, m long, at binary, x binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, their first bytes first, compressed: small ones take little."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpacked(blob: bytes, m: int, kind: str) -> np.ndarray:
    flat = np.frombuffer(pa.Codec("zstd").decompress(blob, 8 * m), np.uint8).reshape(8, m)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def _cell(strip: int, block: int, at: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """A cell's entries: places in it, in order and told by their differences, and values."""
    made = [pa.array([strip], pa.int32()), pa.array([block], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([_packed(np.diff(at, prepend=0))], pa.binary()), pa.array([_packed(x)], pa.binary())]
    return pa.RecordBatch.from_arrays(made, names=["strip", "block", "m", "at", "x"])


def _entries(r: dict, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(r["at"], r["m"], "<i8")), _unpacked(r["x"], r["m"], kind)


def _dealt(i: np.ndarray, j: np.ndarray, x: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Entries (i, j, x) by cells."""
    if not len(i):
        return
    blocks = int(max(i.max(), j.max())) // block + 1
    code = ((i // block * blocks + j // block) * block + i % block) * block + j % block
    order = np.argsort(code)
    code, x = code[order], x[order]
    cell = code // (block * block)
    firsts = np.flatnonzero(np.diff(cell, prepend=-1))
    for low, high in zip(firsts.tolist(), [*firsts[1:].tolist(), len(cell)], strict=True):
        yield _cell(int(cell[low]) // blocks, int(cell[low]) % blocks, code[low:high] % (block * block), x[low:high])


def _summed(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: each cell once, of rows in order of cells."""

    def total(key: tuple[int, int], parts: list[dict]) -> pa.RecordBatch:
        at, x = (np.concatenate(c) for c in zip(*[_entries(r, kind) for r in parts], strict=True))
        order = np.argsort(at, kind="stable")
        at, x = at[order], x[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return _cell(*key, at[first], np.add.reduceat(x, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for r in _rows(batch):
                if (r["strip"], r["block"]) != key and parts:
                    yield total(key, parts)
                    parts = []
                key = r["strip"], r["block"]
                parts.append(r)
        if parts:
            yield total(key, parts)

    return run


def _cells(dealt: DataFrame, strips: int, kind: str) -> DataFrame:
    """Each cell once, a strip's in one partition and in order."""
    return checkpointed(dealt.repartitionById(strips, "strip").sortWithinPartitions("strip", "block").mapInArrow(_summed(kind), _CELL))


def pair_cells(texts: DataFrame, text: Column, words: str, block: int, strips: int, reach: int = REACH) -> DataFrame:
    """Cells of how often pairs of known words stand within `reach` known words of each other, either way round; a word beside itself counts from both its ends."""
    line, near = _lines(words), near_pairs(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in near(line(batches)):
            code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            i, j = code >> 32, code & ((1 << 32) - 1)
            turned = i != j
            yield from _dealt(i, j, np.where(turned, n, 2 * n), block)
            yield from _dealt(j[turned], i[turned], n[turned], block)

    return _cells(texts.select(tokens(text).alias("words")).mapInArrow(run, _CELL), strips, "<i8")


def block_words(total: int) -> tuple[int, int]:
    """(words of a strip or block, strips) of a vocabulary: about STRIPS, so that a task holds a small part of it."""
    block = max(LEAST_WORDS, 1 << (max(total, 1) // STRIPS).bit_length())
    return block, max(1, -(-total // block))


def word_pairs(texts: DataFrame, key: str, text: Column, reach: int = REACH, least: int = LEAST_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(words, pairs): token, i, n of words in `least` texts or more, numbered from 0; and i, j, n of pairs that stand within `reach` known words of each other, either way round; `key` is unique."""
    where, total = known_words(texts, text, least)
    block, strips = block_words(total)
    cells = pair_cells(texts, text, where, block, strips, reach)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                at, n = _entries(r, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(r["strip"] * block + at // block), pa.array(r["block"] * block + at % block), pa.array(n)], names=["i", "j", "n"])

    return texts.sparkSession.read.schema("token string, i long, n long").parquet(where), cells.mapInArrow(listed, "i long, j long, n long")


def _numbers(blob: bytes, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(blob, kind)


_FACTOR = "b int, i binary, v binary"


def _factor(b: int, i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([i.astype("<i8").tobytes()], pa.binary()), pa.array([np.ascontiguousarray(v, "<f8").tobytes()], pa.binary())], names=["b", "i", "v"])


def _stored(factor: DataFrame) -> str:
    return _written(factor, "b")


def _read(spark: SparkSession, factor: str) -> DataFrame:
    return spark.read.schema("i binary, v binary, b int").parquet(factor).select("b", "i", "v")


def _block(factor: str, b: int, block: int, width: int) -> np.ndarray:
    """A block's vectors; zeros for words that have none."""
    dense = np.zeros((block, width))
    for piece in _pieces(f"{factor}/b={b}", ["i", "v"]):
        for r in _rows(piece):
            dense[_numbers(r["i"], "<i8") % block] = _numbers(r["v"]).reshape(-1, width)
    return dense


def _sums(cells: DataFrame, block: int, kind: str) -> DataFrame:
    """b, i, v: the sum of the entries of every word that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, own, there = None, np.zeros(block), np.zeros(block, bool)
        for batch in batches:
            for r in _rows(batch):
                if strip not in (None, r["strip"]):
                    yield _factor(strip, strip * block + np.flatnonzero(there), own[there])
                    own, there = np.zeros(block), np.zeros(block, bool)
                strip = r["strip"]
                at, x = _entries(r, kind)
                own += np.bincount(at // block, x, block)
                there[at // block] = True
        if strip is not None:
            yield _factor(strip, strip * block + np.flatnonzero(there), own[there])

    return cells.mapInArrow(run, _FACTOR)


def _information(sums: str, total: float, block: int) -> Callable[[int, int, np.ndarray, np.ndarray], np.ndarray]:
    """A cell's ln(n N / (n_i n_j)), by its strip, block, places and counts."""
    held: dict[int, np.ndarray] = {}

    def own(b: int) -> np.ndarray:
        if b not in held:
            held[b] = _block(sums, b, block, 1)[:, 0]
        return held[b]

    return lambda strip, b, at, n: np.log(n * total / (own(strip)[at // block] * own(b)[at % block]))


def _add_product(out: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, dense: np.ndarray) -> None:
    """To out's rows i, which are in order, x times dense's rows j: rows of few entries side by side, others each at once."""
    first = np.flatnonzero(np.diff(i, prepend=-1))
    n = np.diff(np.append(first, len(i)))
    few = n <= FEW
    for k in range(FEW):
        at = first[few & (n > k)] + k
        out[i[at]] += x[at, None] * dense.take(j[at], axis=0)
    for low, m, row in zip(first[~few].tolist(), n[~few].tolist(), i[first[~few]].tolist(), strict=True):
        out[row] += x[low : low + m] @ dense.take(j[low : low + m], axis=0)


def product(cells: DataFrame, factor: str, block: int, width: int, weigh: Callable[[int, int, np.ndarray, np.ndarray], np.ndarray] | None = None, by: np.ndarray | None = None) -> DataFrame:
    """b, i, v of the cells' matrix times a factor, and a small matrix; with `weigh`, of what it makes of the cells' counts where that is positive."""

    def told(strip: int, out: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
        return _factor(strip, strip * block + np.flatnonzero(there), out[there] if by is None else out[there] @ by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, out, there = None, np.zeros((block, width)), np.zeros(block, bool)
        for batch in batches:
            for r in _rows(batch):
                if strip not in (None, r["strip"]):
                    yield told(strip, out, there)
                    out, there = np.zeros((block, width)), np.zeros(block, bool)
                strip = r["strip"]
                at, x = _entries(r, "<i8" if weigh else "<f8")
                if weigh:
                    x = weigh(strip, r["block"], at, x)
                    at, x = at[x > 0], x[x > 0]
                i, j, dense = at // block, at % block, _block(factor, r["block"], block, width)
                there[i] = True
                _add_product(out, i, j, x, dense)
        if strip is not None:
            yield told(strip, out, there)

    return cells.mapInArrow(run, _FACTOR)


def _gram(left: DataFrame, width: int, by: np.ndarray | None = None, right: str | None = None, block: int = 0) -> np.ndarray:
    """Left's columns, turned by a small matrix, times themselves, or right's columns times left's: width by width sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                v = _numbers(r["v"]).reshape(-1, width)
                v = v if by is None else v @ by
                out = (v if right is None else _block(right, r["b"], block, width)[_numbers(r["i"], "<i8") % block]).T @ v
                yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()])], names=["g"])

    parts = left.mapInArrow(sums, "g array<double>").select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # width * width numbers
    return np.array([r["x"] for r in sorted(parts)]).reshape(width, width) if parts else np.zeros((width, width))


def _turned(factor: DataFrame, by: np.ndarray) -> DataFrame:
    """factor with every vector multiplied by a small matrix."""
    width = by.shape[0]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                yield _factor(r["b"], _numbers(r["i"], "<i8"), _numbers(r["v"]).reshape(-1, width) @ by)

    return factor.mapInArrow(turn, _FACTOR)


def _listed(factor: DataFrame, width: int) -> DataFrame:
    """i, v: a row for each vector of a factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                names, flat = _numbers(r["i"], "<i8"), _numbers(r["v"])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * width, pa.int32()), pa.array(flat))], names=["i", "v"])

    return factor.mapInArrow(run, "i long, v array<double>")


def _orthonormal(factor: DataFrame, width: int) -> np.ndarray:
    """The small matrix that makes a factor's columns orthonormal; directions that are not there become zero."""
    turn = np.eye(width)
    for again in (False, True):  # once more, for what rounding left
        values, axes = np.linalg.eigh(_gram(factor, width, turn if again else None))
        there = values > max(values.max(), 0) * 1e-12
        turn = turn @ (axes * np.where(there, 1 / np.sqrt(np.where(there, values, 1)), 0))
    return turn


def matrix_cells(matrix: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(cells of entries (i, j, x), words of a block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _dealt(*(batch.column(c).to_numpy() for c in range(3)), block)

    last = matrix.agg(F.max(F.greatest("i", "j"))).first()[0] or 0
    return _cells(matrix.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("x").cast("double")).mapInArrow(run, _CELL), last // block + 1, "<f8"), block


def times(matrix: DataFrame, factor: DataFrame, width: int, block: int = 1 << 14) -> DataFrame:
    """i, v of matrix (i, j, x) times factor (i, v: width numbers), a row for each vector."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_factor(table.column("b")[0].as_py(), table.column("i").to_numpy(), np.array(table.column("v").to_pylist(), np.float64))])

    cells, _ = matrix_cells(matrix, block)
    stored = _stored(factor.withColumn("b", F.floor(F.col("i") / block).cast("int")).groupBy("b").applyInArrow(pack, _FACTOR))
    return _listed(product(cells, stored, block, width), width)


def axes_of(cells: DataFrame, sums: str, block: int, size: int, extra: int = EXTRA, powers: int = POWERS, seed: int = 0, weigh: Callable[[int, int, np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, np.ndarray]:
    """main_axes() of a matrix's cells; sums: the stored words that it has.

    A factor lies in files as it was multiplied; the small matrix that makes it
    orthonormal is applied to its products, which comes to the same.
    """
    width, spark = size + extra, cells.sparkSession

    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                names = _numbers(r["i"], "<i8")
                yield _factor(r["b"], names, np.stack([np.random.default_rng([seed, int(i)]).normal(size=width) for i in names]))

    found, turn = _stored(_read(spark, sums).mapInArrow(draws, _FACTOR)), np.eye(width)
    for _ in range(powers):
        found, before = _stored(product(cells, found, block, width, weigh, turn)), found
        _dropped(before)
        turn = _orthonormal(_read(spark, found), width)
    small = turn.T @ _gram(product(cells, found, block, width, weigh), width, None, found, block) @ turn
    values, axes = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:size]
    values, axes = np.abs(values[order]), axes[:, order]
    return _listed(_turned(_read(spark, found), turn @ (axes * np.sqrt(values))), size), values


def main_axes(matrix: DataFrame, size: int = SIZE, extra: int = EXTRA, powers: int = POWERS, block: int = 1 << 14, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(i, v of the main axes scaled by the root of their weight; the weights, descending) of a symmetric sparse matrix (i, j, x)."""
    cells, block = matrix_cells(matrix, block)
    return axes_of(cells, _stored(_sums(cells, block, "<f8")), block, size, extra, powers, seed)


def word_vectors(texts: DataFrame, key: str, text: Column, size: int = SIZE, reach: int = REACH, least: int = LEAST_TEXTS) -> DataFrame:
    """token, n, v: a vector of `size` numbers for every word in `least` texts or more that has neighbours; the same at every run but for rounding. `key` is unique."""
    where, total = known_words(texts, text, least)
    block, strips = block_words(total)
    cells = pair_cells(texts, text, where, block, strips, reach)
    sums = _stored(_sums(cells, block, "<i8"))
    pairs = _total(_read(texts.sparkSession, sums))
    vectors, _ = axes_of(cells, sums, block, size, weigh=_information(sums, pairs, block))
    return texts.sparkSession.read.schema("token string, i long, n long").parquet(where).join(vectors, "i").select("token", "n", "v")


def _total(sums: DataFrame) -> float:
    """The sum of all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(_numbers(v).sum() for v in batch.column("v").to_pylist()))])], names=["x"])

    return sums.mapInArrow(run, "x double").agg(F.sum("x")).first()[0] or 1.0


def text_vectors(texts: DataFrame, key: str, text: Column, vectors: DataFrame, size: int = SIZE, smooth: float = SMOOTH, keep: list[str] = ()) -> DataFrame:
    """key, embedding and what else to keep: the mean of a text's word vectors, rare words weighing more, of length 1; zeros where no word is known.

    Vectors are looked up in files, so no text's words travel.
    """
    where = _written(vectors.select("token", "n", "v"))
    spark, kinds = texts.sparkSession, dict(texts.dtypes)
    total = float(spark.read.schema("n long").parquet(where).agg(F.sum("n")).first()[0] or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, text, word = _words_of(batch.column(batch.num_columns - 1))
            pair, often = np.unique(text * max(len(names), 1) + word, return_counts=True)
            text, word = pair // max(len(names), 1), pair % max(len(names), 1)
            out = np.zeros((batch.num_rows, size))
            for piece in _pieces(where, ["token", "n", "v"]):
                place = pa.compute.index_in(names, piece.column(0)).fill_null(-1).to_numpy()
                held = np.flatnonzero(place[word] >= 0)
                if not len(held):
                    continue
                n, v = piece.column(1).to_numpy(), piece.column(2).flatten().to_numpy().reshape(-1, size)
                for low in range(0, len(held), ENTRIES):
                    cut = held[low : low + ENTRIES]
                    at = place[word[cut]]
                    weight = often[cut] * smooth / (smooth + n[at] / total)
                    first = np.flatnonzero(np.diff(text[cut], prepend=-1))
                    out[text[cut][first]] += np.add.reduceat(weight[:, None] * v[at], first)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * size, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], unit], names=[key, *keep, "embedding"])

    given = texts.select(key, *keep, tokens(text).alias("_words"))
    return given.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [key, *keep]) + ", embedding array<double>")
