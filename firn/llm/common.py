"""Helpers the operators share."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes of text a task turns into Python objects at once.
PIECE = 4 << 20


def remainder(col, n):
    """crc32 of the id's text modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def held_out(col, n):
    """True where the remainder is 0; rows without an id are not held out."""
    return F.coalesce(remainder(col, n) == 0, F.lit(False))


def fresh(df, *names):
    """Column names that `df` does not use yet, whatever their case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def row_key(id_col, text_col):
    """64 bits that stand for the id and the text of a row; never null."""
    return F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col))


#: Keys with more than one of so many rows are hot; there are fewer of them than this.
SHARE = 1000


def attach(left, right, on, weight):
    """Left outer join of rows with one row per key, safe for hot keys.

    `right` has one row per value of the column `on` and, in `weight`, at least the number of
    rows of `left` that bear it. Keys with more than a SHARE-th of the total weight are fewer than SHARE, so
    their rows of `right` are broadcast; all other keys are shuffled. Both tables should be
    written ones, since they are read twice. Null keys find nothing.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot, = fresh(left, "_hot")
    rest = [c for c in right.columns if c != on]
    heavy = right.where(F.col(weight) > F.lit(total / SHARE))
    light = right.where(F.col(weight) <= F.lit(total / SHARE))
    marked = left.join(F.broadcast(heavy.select(on, F.struct(*rest).alias(hot))), on, "left")
    found = marked.where(F.col(hot).isNotNull()).select(*left.columns, *[F.col(f"{hot}.{c}").alias(c) for c in rest])
    return found.unionByName(marked.where(F.col(hot).isNull()).drop(hot).join(light, on, "left").select(*left.columns, *rest))


def pieces(batches, column):
    """Slices of the Arrow batches that hold about PIECE bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def as_bytes(batch, column):
    """The UTF-8 bytes of every text; None stays None."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def as_list(batch, column):
    return batch.column(column).to_pylist()


def record_batch(schema, **columns):
    arrow = {f.name: f.type for f in schema}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in arrow.items()], schema=schema)


def pad(k):
    """Odd multipliers of a polynomial hash: powers and inverse powers up to k."""
    if k >= len(_POWERS[0]):
        n = max(1 << 16, 1 << int(k).bit_length())
        p = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            for i, base in enumerate((p, pow(p, -1, 1 << 64))):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                _POWERS[i] = np.cumprod(row, dtype=np.uint64)
    return _POWERS


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def mixed(h):
    """Spread the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(data):
    """Where the words of some bytes start and end, and a 64-bit hash of each."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[a]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, inverse = pad(len(a))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers[: len(a)], out=sums[1:])
        h = (sums[end] - sums[start]) * inverse[start]
    return start, end, mixed(h)


def gram_hashes(words, n):
    """A 64-bit hash of every run of n words, given the words' hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    return mixed(h)
