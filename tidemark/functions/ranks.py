"""Exact order statistics of many columns at once, in a number of jobs that depends on neither columns nor rows."""

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates that reach the driver at most, and bits of a value that one job decides.
FEW, BITS = 1 << 16, 8


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _keys(column: pa.Array) -> np.ndarray:
    values = column.drop_null().to_numpy(zero_copy_only=False)
    return _ordered(values[~np.isnan(values)])


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def _narrow(wanted: dict, cells: dict) -> tuple[dict, int]:
    """Prefixes one digit longer with the (rank inside, rank asked for) they hold, and the values under them."""
    digits: dict = {}
    for (c, prefix, d), n in cells.items():
        digits.setdefault((c, prefix), []).append((d, n))
    out, held = {}, 0
    for (c, prefix), ranks in wanted.items():
        below = 0
        for d, n in sorted(digits[c, prefix]):
            inside = [(rank - below, asked) for rank, asked in ranks if below <= rank < below + n]
            if inside:
                out[c, prefix << BITS | d] = inside
                held += n
            below += n
    return out, held


def exact_ranks(df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]]) -> dict[str, list[float]]:
    """Per column the values at ``ranks(n)`` (0-based) among its ``n`` non-missing ones; none if ``n`` is 0.

    Each job decides eight more bits of every wanted value of every column: tasks count the
    values under each prefix that still holds a wanted rank. When few candidates are left they
    are fetched. ``df`` is read up to nine times, so stage it.
    """
    columns = list(columns)
    if not columns:
        return {}
    frame = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    wanted: dict[tuple[int, int], list[tuple[int, int]]] | None = None
    asked: dict[int, list[int]] = {}
    values: dict[tuple[int, int], float] = {}

    for done in range(0, 64, BITS):
        prefixes = {i: np.array(sorted(p for c, p in wanted if c == i) if wanted else [0], np.uint64) for i in range(len(columns))}

        def tally(batches, prefixes=prefixes, done=done):
            sums = {i: np.zeros(len(p) << BITS, np.int64) for i, p in prefixes.items()}
            for batch in batches:
                for i, own in prefixes.items():
                    if len(own):
                        keys = _keys(batch.column(i))
                        top = _top(keys, done)
                        at = np.minimum(np.searchsorted(own, top), len(own) - 1)
                        hit = own[at] == top
                        digit = _top(keys, done + BITS) & np.uint64((1 << BITS) - 1)
                        sums[i] += np.bincount((at[hit] << BITS) + digit[hit].astype(np.int64), minlength=len(sums[i]))
            cells = [(i, int(k), int(v[k])) for i, v in sums.items() for k in np.flatnonzero(v)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in cells], pa.int64()) for k in range(3)], names=["c", "k", "n"])

        counted = frame.mapInArrow(tally, "c long, k long, n long").groupBy("c", "k").agg(F.sum("n")).collect()
        cells = {(c, int(prefixes[c][k >> BITS]), k & ((1 << BITS) - 1)): n for c, k, n in counted}
        if wanted is None:
            sizes = {i: sum(n for (c, _, _), n in cells.items() if c == i) for i in range(len(columns))}
            asked = {i: list(ranks(n)) if n else [] for i, n in sizes.items()}
            wanted = {(i, 0): [(r, r) for r in sorted(set(rs))] for i, rs in asked.items() if rs}
        wanted, left = _narrow(wanted, cells)
        if not wanted or left <= FEW:
            break
    bits = done + BITS
    if wanted and bits < 64:
        prefixes = {i: np.array(sorted(p for c, p in wanted if c == i), np.uint64) for i in range(len(columns))}

        def fetch(batches):
            for batch in batches:
                for i, own in prefixes.items():
                    if len(own):
                        keys = _keys(batch.column(i))
                        found = keys[np.isin(_top(keys, bits), own)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(found.view(np.int64))], names=["c", "k"])

        held: dict = {}
        for c, k in frame.mapInArrow(fetch, "c long, k long").collect():
            key = k & (2**64 - 1)
            held.setdefault((c, key >> (64 - bits)), []).append(key)
        for at, inside in wanted.items():
            found = sorted(held[at])
            values.update({(at[0], r): _double(found[rank]) for rank, r in inside})
    else:
        values.update({(at[0], r): _double(at[1]) for at, inside in wanted.items() for _, r in inside})
    return {name: [values[i, r] for r in asked[i]] for i, name in enumerate(columns)}


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column; None for a column without values."""
    found = exact_ranks(df, columns, lambda n: [(n - 1) // 2, n // 2])
    return {c: (v[0] if v[0] == v[1] else (v[0] + v[1]) / 2) if v else None for c, v in found.items()}
