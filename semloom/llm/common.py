"""Helpers shared by the corpus operators: column picking, byte-level batch access, checkpoints."""

from __future__ import annotations

import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker whatever the batch holds.
SLICE_BYTES = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str | None) -> DataFrame:
    """The named columns under new names: pick(df, id="doc_id"). Other columns can't clash, even when they
    differ from a wanted one by case only or repeat its name (then the first exact match counts)."""
    at = {new: df.columns.index(old) for new, old in cols.items() if old is not None}
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(new) for new, i in at.items()])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(df with its columns named _c0, _c1, ..., {name: its new name}), so that a stage can add and join columns whatever
    the others are called; .toDF(*names) undoes it. Of equal names the first counts."""
    at: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, f"_c{i}")
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all of Spark runs in this process, else
    an error, as executors elsewhere couldn't reach it."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return tempfile.mkdtemp(prefix="semloom-")


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about `limit` bytes; a longer text comes alone, whole."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_bytes(batch.column(col))
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, offsets); a null row has no bytes."""
    wide = pa.types.is_large_string(column.type)
    n, dtype = len(column), np.int64 if wide else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=dtype, count=n + 1, offset=column.offset * dtype().itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if len(have) <= 4 * SLICE_BYTES:  # a longer one is for a rare text and isn't kept
            _powers[key] = have
    return have[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each raw[start:end], equal for equal bytes wherever they lie."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(span_sums(prefix_sums(raw), starts, ends) + (ends - starts).astype(np.uint64))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """What span_sums() needs of all bytes."""
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(len(raw), _B, "b"), out=prefix[1:])
    return prefix


def span_sums(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial of each span's bytes, not mixed yet."""
    return (prefix[ends] - prefix[starts]) * span_scale(starts)


def span_scale(starts: np.ndarray) -> np.ndarray:
    """What a difference of prefix_sums() from each start on is multiplied by."""
    return _power(int(starts.max(initial=0)) + 1, _B_INV, "i")[starts]


#: Byte -> folded byte: ASCII letters lower case, other ASCII but digits a space; bytes of longer characters stay.
FOLD = np.array([b if chr(b).isdigit() or b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _folded(c: str) -> int:
    """Code point of a character's lower case, if that takes as many bytes; 0 for punctuation, symbols and spaces."""
    if unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) in ("Cc", "Cf"):
        return 0
    low = c.lower()
    return ord(low) if len(low) == 1 and len(low.encode()) == len(c.encode()) else ord(c)


#: Code point of two or three bytes -> folded code point. Surrogates can't occur.
_FOLD_WIDE = np.array([0 if i < 128 else i if 0xD800 <= i < 0xE000 else _folded(chr(i)) for i in range(1 << 16)], np.uint16)


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case, punctuation and other separators as spaces; as long as the input. Letters whose lower case takes more
    or fewer bytes, and characters of four bytes, stay as they are."""
    out = FOLD[raw]
    wide = np.flatnonzero(raw >= 0xC2)
    if len(wide):
        lead = raw[wide].astype(np.uint16)
        at = wide[lead < 0xE0]
        low = _FOLD_WIDE[(raw[at].astype(np.uint16) & 31) << 6 | raw[at + 1] & 63]
        out[at], out[at + 1] = np.where(low, low >> 6 | 0xC0, 32), np.where(low, low & 63 | 0x80, 32)
        at = wide[(lead >= 0xE0) & (lead < 0xF0)]
        if len(at):
            low = _FOLD_WIDE[(raw[at].astype(np.uint16) & 15) << 12 | (raw[at + 1].astype(np.uint16) & 63) << 6 | raw[at + 2] & 63]
            out[at], out[at + 1], out[at + 2] = np.where(low, low >> 12 | 0xE0, 32), np.where(low, low >> 6 & 63 | 0x80, 32), np.where(low, low & 63 | 0x80, 32)
    return out


def words(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of bytes above a space; no run crosses a row."""
    n = len(folded)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = folded > 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row (ascending), 0 where a row has none."""
    out = np.zeros((n, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    if len(values):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(values, first, axis=0, dtype=out.dtype)
    return out


def comb(rows: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """An automaton's transitions {symbol below 256: state} of each state, laid into one array of about a slot each.

    (base, table): base is each state's own number; table[base[s] + c] is base[s] << 32 | base[t] where c leads from s to
    t, and has another state's number in its upper half where c leads nowhere. Rows of several transitions are laid first
    fit, the rest fills the gaps."""
    base = np.full(len(rows), -1, np.int64)
    used, taken = bytearray(1 << 12), bytearray(1 << 12)  # slots with a transition, numbers that a state has

    def room(n: int) -> None:
        for a in (used, taken):
            if len(a) < n:
                a.extend(bytes(max(n - len(a), len(a))))

    many = sorted((s for s, r in enumerate(rows) if len(r) > 1), key=lambda s: -len(rows[s]))
    at = 256
    for s in many:
        symbols = sorted(rows[s])
        slot, tries = used.find(0, at), 0
        while True:
            b = slot - symbols[0]
            room(b + 512)
            if not taken[b] and not any(used[b + c] for c in symbols):
                break
            tries += 1
            slot = used.find(0, slot + 1)
            if tries % 16 == 0:  # few gaps are left here
                at = slot
        base[s], taken[b] = b, 1
        for c in symbols:
            used[b + c] = 1
    slot = 255
    for s, r in enumerate(rows):
        if len(r) != 1:
            continue
        (c,) = r
        slot = used.find(0, slot + 1)
        while True:
            room(slot + 512)
            if slot >= c and not taken[slot - c]:
                break
            slot = used.find(0, slot + 1)
        base[s], taken[slot - c], used[slot] = slot - c, 1, 1
    b = 0
    for s, r in enumerate(rows):  # a state without transitions only needs a number
        if not r:
            b = taken.find(0, b)
            while b < 0:
                room(2 * len(taken))
                b = taken.find(0)
            base[s], taken[b] = b, 1
    table = np.full(int(base.max(initial=0)) + 256, -1, np.int64)
    size = [len(r) for r in rows]
    own = np.repeat(base, size)
    symbols = np.fromiter((c for r in rows for c in r), np.int64, len(own))
    table[own + symbols] = own << 32 | base[np.fromiter((t for r in rows for t in r.values()), np.int64, len(own))]
    return base, table
