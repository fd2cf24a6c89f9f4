"""Shared helpers: lineage cuts in the shared folder, and byte-level numpy kernels on Arrow text columns."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one kernel call works on; a single longer text makes a call of its own.
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: the one in ``spark.checkpoint.dir``.

    Only on a local master, where they are one process, is a temporary one chosen if none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def stash(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, at_a_time: int | None = None) -> DataFrame:
    """The same rows, written as Parquet in the session's shared folder and read again: columns stay compressed.

    ``at_a_time``: rows that go to Python in one Arrow batch meanwhile, where rows are large."""
    spark, path, most = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    try:
        if at_a_time:
            spark.conf.set(most, str(at_a_time))
        df.write.parquet(path)
    finally:
        spark.conf.set(most, before)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_POWERS: dict[tuple[bool, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, again: bool = False) -> np.ndarray:
    """Powers of one of two bases (``again``: the other one) modulo 2^64, or of its inverse."""
    have = _POWERS.get((inverse, again))
    if have is None or len(have) < n:
        base = _BASES[again]
        out = np.full(max(n, SLICE_BYTES + (1 << 17)), _U(pow(base, -1, 1 << 64) if inverse else base), dtype=_U)
        out[0] = 1
        have = _POWERS[inverse, again] = np.multiply.accumulate(out)
    return have[:n]


_BYTES = seeded(256, 11)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each row's first word (one entry more than rows);
    ``gaps`` says which bytes stand between words."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~gaps[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words for features, A-Z as a-z where asked for: sums over letters and places, so that long
    words can be made to agree. What must tell words apart takes ``word_keys``."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[raw] * powers(len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(raw), inverse=True)[starts] + (ends - starts).astype(_U))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = seeded(2, 41)
#: Bytes of a word up to which it is hashed block by block with all others; longer ones are digested one by one.
LONG_WORD = 256


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, again: bool = False) -> np.ndarray:
    """64-bit keys of the words, A-Z as a-z where asked for: each block of eight bytes is mixed into what the blocks
    before it gave, from a start that depends on the length. ``again`` starts from another seed, so that words that
    agree by chance in one key do not in the other."""
    if lower:
        raw = _LOWER[raw]
    size = ends - starts
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    blocks = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    seed = _SEEDS[int(again)]
    keys = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + seed)
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        rest = size[live] - at
        block = blocks[starts[live] + at]
        short = rest < 8
        block[short] &= (_U(1) << (rest[short] * 8).astype(_U)) - _U(1)
        keys[live] = mix((keys[live] ^ block) + seed)
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.tobytes()).digest()
        keys[i] = np.frombuffer(digest, dtype="<u8")[0]
    return keys
