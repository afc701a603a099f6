"""What several operators share: table access, joins, text helpers (and, from the library, lineage cuts and components)."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.lineage import checkpoint_dir, components, counted, cut, free_names, release, remove

__all__ = ["checkpoint_dir", "components", "counted", "cut", "free_names", "release", "remove"]

#: A word: a run of anything but ASCII white space. ``bytes.split()`` gives the same words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(name: str = "doc_id") -> Column:
    """crc32 of an id's decimal text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hands freed memory back to the system (where the C library can), which a Python worker would keep between tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` text bytes (one row at least), to bound memory."""
    lengths = _lengths(batch.column(column))
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def with_columns_of(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, null equal to null; the keys of ``left`` stay. The other columns of
    ``right`` must not be among those of ``left`` (see ``free_names``)."""
    theirs = free_names([*left.columns, *right.columns], *keys)
    other = right.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)], *[c for c in right.columns if c not in keys])
    on = None
    for k, t in zip(keys, theirs, strict=True):
        e = F.col(k).eqNullSafe(F.col(t))
        on = e if on is None else on & e
    return left.join(other, on, how).drop(*theirs)


def beside_groups(rows: DataFrame, groups: DataFrame, key: str, most: int = 1000, count: str = "n") -> DataFrame:
    """``rows`` with the values of their group: ``groups`` has a row a key (null is a key too), with its ``count`` of rows.

    The ``most`` largest groups go by broadcast, never more; what is left is shuffled, where no key has more than one part in
    ``most`` of all rows. Columns of ``groups`` other than the key must not be among those of ``rows``.
    """
    hot = cut(groups.orderBy(F.desc(count), F.col(key).asc_nulls_first()).limit(most))
    theirs, mark = free_names([*rows.columns, *groups.columns], key, "_hot")
    values = [c for c in groups.columns if c not in (key, count)]
    named = lambda g: g.select(F.col(key).alias(theirs), *values)
    same = F.col(key).eqNullSafe(F.col(theirs))
    first = rows.join(F.broadcast(named(hot)), same).drop(theirs)
    rest = rows.join(F.broadcast(named(hot).select(theirs)), same, "left_anti")
    others = named(groups).join(F.broadcast(named(hot).select(F.col(theirs).alias(mark))), F.col(theirs).eqNullSafe(F.col(mark)), "left_anti")
    return first.unionByName(rest.join(others, same, "left").drop(theirs))


def store(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again; smaller there than ``cut``."""
    path = f"{checkpoint_dir(df.sparkSession)}/pathloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LONG = 32  # bytes; beyond, a polynomial modulo a power of two can be led to equal values by the word's shape alone
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UP, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), 1 << 20
_DOWN = np.uint64(pow(int(_UP), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_UP, _DOWN)]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_VALUE, _CHECK = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (1, 2))


def hashed_words(texts: list[bytes], value: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, by array operations: 64-bit hashes, starts and ends in the returned bytes (texts joined
    by a space), and each text's number of words. A word's hash is the same everywhere: a polynomial over its bytes, or
    xxh3 if it has more than ``LONG``."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~_SPACE[data]
    turns = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = turns[::2], turns[1::2]
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STEP, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(max(_STEP, b - a))
        run = np.zeros(b - a + 1, np.uint64)
        np.add.accumulate(value[data[a:b]] * up[: b - a], out=run[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        seed, whole = int(value[0]), data.data
        hashes[long] = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    per = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return mixed(hashes), starts, ends, data, per


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of texts as codes (order of the words' bytes), the words, and each text's number of words (told apart
    by 128 bits)."""
    hashes, starts, ends, data, per = hashed_words(texts)
    by = np.argsort(hashes)
    new = np.insert(hashes[by][1:] != hashes[by][:-1], 0, True) if len(by) else np.zeros(0, bool)
    codes = np.empty(len(by), np.int64)
    codes[by] = np.cumsum(new) - 1
    first = by[new]
    whole = data.tobytes()
    words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    check = hashed_words(texts, _CHECK)[0]
    if (check != check[first[codes]]).any():  # two words with one hash: by dictionary instead
        table: dict[bytes, int] = {}
        codes = np.array([table.setdefault(whole[a:b], len(table)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        words = list(table)
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.uint32)
    rank[np.array(order, np.int64)] = np.arange(len(words), dtype=np.uint32)
    return rank[codes] if len(words) else np.zeros(0, np.uint32), [words[i] for i in order], per



def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
