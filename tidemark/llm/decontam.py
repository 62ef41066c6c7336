"""Benchmark decontamination: windows within a small edit distance of an item.

Symbols are words, lower-cased and without punctuation around them. A window has as many
words as the item (a shorter text is one window); it is a hit if at most a fifth of the
item's words have to be edited.

A window goes through bounds that do not depend on how many items there are: enough of its
words must occur in items of that length (one running sum), and none counts more often than
any item of that length has it. What is left goes through the CGK walk: step ``j`` writes the
current word and, by a random bit of (repetition, step, word), stays or moves on. Two
sequences a few edits apart soon walk in step again, so edit distance becomes Hamming
distance, and a few sampled positions of the output are a hash that near pairs share. Every
other repetition walks from the window's end, so that edits near one end do not hide it.

A table holds the hashes of all items by (length, repetition); windows are looked up in it, and
only what they find there is verified, by exact edit distance. The number of samples grows
with the logarithm of the items of a length, which keeps chance finds few; repetitions are
added until the chance to miss a pair at the limit, measured on random edits, is below
``1 - recall``. For 30 words, 6 edits and two samples, recall 0.999 takes about half the
repetitions of 0.9999.

Documents are never shuffled. Items are broadcast in blocks of at most ``BLOCK_CHARS``
characters, one pass over the documents for each block.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shards

SHARE, RECALL = 0.2, 0.9999
#: Characters of items that are broadcast at once, and words whose symbol a task remembers.
BLOCK_CHARS, KNOWN = 4_000_000, 1 << 17
_AROUND = string.punctuation
HITS = "array<struct<item_id:bigint,start_word:bigint,n_words:bigint,edits:bigint>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))


def words(text: str | None) -> list[str]:
    found = (w.strip(_AROUND) for w in (text or "").lower().split())
    return [w for w in found if w]


def edit_limit(n, share: float = SHARE):
    return np.floor(np.asarray(n) * share + 1e-9).astype(np.int64)


_STEP, _REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def samples(items: int) -> int:
    """Sampled positions of a hash, for so many items of one length."""
    return max(1, round(1 + math.log10(max(items, 1))))


def positions(n: int, repeats: int, size: int) -> np.ndarray:
    """The sampled output positions of each repetition, one of each part of the output.

    A walk writes a word several times when it stays, so positions close together tell little.
    """
    ends = np.arange(size + 1) * max(n, size) // size
    return np.stack([np.random.default_rng((n, size, r)).integers(ends[:-1], ends[1:]) for r in range(repeats)])


def walk_keys(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """By repetition and window, a hash of the sampled outputs; after its end a window gives 0.

    The bit that moves a walk on is one of 64 that a hash of (word, repetition) gives.
    """
    repeats = np.arange(len(sampled))[:, None]
    back = repeats % 2 == 1
    at = np.zeros((len(sampled), len(start)), np.int64)
    key = np.broadcast_to(shards.mix(repeats.astype(np.uint64) * _REPEAT + _STEP), at.shape).copy()
    for j in range(int(sampled.max()) + 1):
        inside = at < size
        place = np.where(back, start + size - 1 - at, start + at)
        now = np.where(inside, symbols[np.clip(place, 0, len(symbols) - 1)], 0).astype(np.uint64)
        seen = np.flatnonzero((sampled == j).any(1))
        if len(seen):
            key[seen] = shards.mix(key[seen] * np.uint64(31) ^ now[seen])
        bits = shards.mix(now * _STEP + repeats.astype(np.uint64) * _REPEAT + np.uint64(j >> 6))
        at += inside & ((bits >> np.uint64(j & 63)) & np.uint64(1)).astype(bool)
    return key


@lru_cache(1 << 12)
def repetitions(n: int, edits: int, size: int, recall: float, trials: int = 200, tries: int = 64) -> int:
    """How many repetitions reach this recall for sequences of ``n`` words after random edits.

    Some edits throw the walk further off than others, so the chance to miss is averaged
    over pairs, each with its own rate, and not taken from the average rate.
    """
    rng = np.random.default_rng((n, edits))
    rows = np.arange(1, n + 1) + np.zeros((trials, 1), np.int64)
    pairs = []
    for row in rows.tolist():
        other = list(row)
        for k in range(edits):
            kind, at = rng.integers(3), int(rng.integers(len(other)))
            if kind == 0:
                other[at] = n + 1 + k
            elif kind == 1:
                other.insert(at, n + 1 + k)
            else:
                other.pop(at)
        pairs.append((other + [n + 1 + edits] * n)[:n])
    flat = np.concatenate([rows.ravel(), np.array(pairs).ravel()])
    keys = walk_keys(flat, np.arange(2 * trials) * n, np.full(2 * trials, n), positions(n, tries, size))
    miss = 1 - ((keys[:, :trials] == keys[:, trials:]).sum(0) + 0.5) / (tries + 0.5)
    repeats = 1
    while (miss**repeats).mean() > 1 - recall:
        repeats = math.ceil(repeats * 1.1 + 0.1)
    return repeats


def edit_distances(left, left_size, right, right_size) -> np.ndarray:
    """Edit distance of each row of two padded matrices."""
    columns = np.arange(right.shape[1] + 1)
    last = np.tile(columns, (len(left), 1))
    out = np.take_along_axis(last, right_size[:, None], 1)[:, 0].copy()
    for i in range(left.shape[1]):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        np.minimum(last[:, :-1] + (left[:, i, None] != right), last[:, 1:] + 1, out=now[:, 1:])
        # Inserts in a row: the least of all cells to the left, one more for each step.
        last = np.minimum.accumulate(now - columns, axis=1) + columns
        done = left_size == i + 1
        out[done] = np.take_along_axis(last[done], right_size[done, None], 1)[:, 0]
    return out


@dataclass
class Length:
    """The items of one length: ids, words, how often any has a word, and the sorted table of their hashes."""

    n: int
    limit: int
    ids: np.ndarray
    words: np.ndarray
    most: np.ndarray
    sampled: np.ndarray
    keys: np.ndarray
    owner: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(window, item) of each window and item that share a hash, once each."""
        flat = keys.ravel()
        first, last = np.searchsorted(self.keys, flat), np.searchsorted(self.keys, flat, "right")
        hit = np.flatnonzero(last > first)
        n = last[hit] - first[hit]
        entry = np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.unique(np.repeat(hit % keys.shape[1], n) * len(self.ids) + self.owner[entry])


class Items:
    """The items of one block by length, with the tables of their hashes."""

    def __init__(self, rows: list[tuple[int, str]], share: float, recall: float):
        self.share = share
        groups: dict[int, list] = {}
        self.symbol: dict[str, int] = {}
        for i, found in sorted((i, words(t)) for i, t in rows if i is not None):
            if found:
                groups.setdefault(len(found), []).append((i, [self.symbol.setdefault(w, len(self.symbol) + 1) for w in found]))
        self.known: dict[str, int] = {}
        self.lengths = [self._length(n, *zip(*groups[n], strict=True), recall) for n in sorted(groups)]

    def _length(self, n: int, ids: tuple, rows: tuple, recall: float) -> Length:
        matrix, limit = np.array(rows, np.int32), int(edit_limit(n, self.share))
        ordered = np.sort(matrix, axis=1)
        again = _repeats(ordered)
        most = np.zeros(len(self.symbol) + 1, np.int16)
        np.maximum.at(most, ordered.ravel(), (again + 1).ravel().astype(np.int16))
        size = samples(len(ids))
        sampled = positions(n, repetitions(n, limit, size, recall), size)
        keys = walk_keys(matrix.ravel(), np.arange(len(ids)) * n, np.full(len(ids), n), sampled)
        order = np.argsort(keys, axis=None)
        return Length(n, limit, np.array(ids), matrix, most, sampled, keys.ravel()[order], (order % len(ids)).astype(np.int32))

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the texts' words (0: in no item) and each text's number of words."""
        known, flat, sizes = self.known, [], []
        if len(known) > KNOWN:
            known.clear()
        for text in texts:
            before = len(flat)
            for word in (text or "").lower().split():
                symbol = known.get(word)
                if symbol is None:
                    bare = word.strip(_AROUND)
                    # A word of punctuation only is none.
                    symbol = known[word] = self.symbol.get(bare, 0) if bare else -1
                if symbol >= 0:
                    flat.append(symbol)
            sizes.append(len(flat) - before)
        return np.array(flat, np.int64), np.array(sizes, np.int64)

    def windows(self, own: Length, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and size of the windows that could be near some item of this length."""
        n, need, ends = own.n, own.n - own.limit, np.cumsum(sizes)
        known = np.r_[0, np.cumsum(own.most[symbols] > 0)]
        start = np.flatnonzero(known[n:] - known[:-n] >= need) if len(symbols) >= n else np.empty(0, np.int64)
        text = np.searchsorted(ends, start, side="right")
        whole = start + n <= ends[text] if len(start) else np.empty(0, bool)
        start, text = start[whole], text[whole]
        short = np.flatnonzero((sizes < n) & (sizes >= need) & (sizes > 0))
        size = np.r_[np.full(len(start), n), sizes[short]].astype(np.int64)
        start, text = np.r_[start, (ends - sizes)[short]], np.r_[text, short]
        kept = [np.empty(0, bool)]
        for i in range(0, len(start), 8192):
            cells = np.sort(_cells(symbols, start[i : i + 8192], size[i : i + 8192], n, 0), axis=1)
            kept.append((_repeats(cells) < own.most[cells]).sum(1) >= need)
        use = np.concatenate(kept)
        return text[use], start[use], size[use]

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its hits: item, first word, words of the window, edits; the best window of each item."""
        found: list[dict] = [{} for _ in texts]
        symbols, sizes = self.symbols(texts)
        begins = np.cumsum(sizes) - sizes
        for own in self.lengths:
            text, start, size = self.windows(own, symbols, sizes)
            for a in range(0, len(start), 2048):
                part = slice(a, a + 2048)
                pairs = own.find(walk_keys(symbols, start[part], size[part], own.sampled))
                for i in range(0, len(pairs), 4096):
                    window, item = np.divmod(pairs[i : i + 4096], len(own.ids))
                    window += a
                    cells = _cells(symbols, start[window], size[window], own.n, -1)
                    edits = edit_distances(cells, size[window], own.words[item], np.full(len(item), own.n))
                    for k in np.flatnonzero(edits <= own.limit).tolist():
                        t, which = int(text[window[k]]), int(own.ids[item[k]])
                        mine = (int(edits[k]), int(start[window[k]] - begins[t]), int(size[window[k]]))
                        best = found[t].get(which)
                        if best is None or mine < best:
                            found[t][which] = mine
        return [[(i, at, m, e) for i, (e, at, m) in sorted(f.items())] for f in found]


def _cells(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, n: int, empty: int) -> np.ndarray:
    """The windows as rows of ``n`` symbols, ``empty`` after a short one's end."""
    inside = np.arange(n) < size[:, None]
    return np.where(inside, symbols[np.minimum(start[:, None] + np.arange(n), len(symbols) - 1)], empty)


def _repeats(ordered: np.ndarray) -> np.ndarray:
    """How often each symbol of a sorted row came before in it."""
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    columns = np.arange(ordered.shape[1])
    return columns - np.maximum.accumulate(np.where(new, columns, 0), axis=1)


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE, recall: float = RECALL, block_chars: int = BLOCK_CHARS, text_col="text") -> DataFrame:
    """Adds ``hits``: the items that a window of the text matches, with the best window of each.

    ``items`` has item_id and text. Items without words or id match nothing, and so do NULL
    and empty texts. Of equally good windows the first is given. Items that repeat an id
    count as one. An existing column ``hits`` is replaced.
    """
    spark = docs.sparkSession
    shards.small_batches(spark)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    kept = docs.select([c for c in docs.columns if c != "hits"])
    out = kept.withColumn("hits", F.array().cast(HITS))
    at = kept.columns.index(text_col)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in part], share, recall))

        def run(batches, shared=shared, last=len(kept.columns)):
            for batch in batches:
                column = batch.column(at)
                for i, j in shards.chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                    found = shared.value.hits(column[i:j].to_pylist())
                    before = batch.column(last)[i:j].to_pylist()
                    hits = [b + [dict(zip(("item_id", "start_word", "n_words", "edits"), h, strict=True)) for h in f] for b, f in zip(before, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], pa.array(hits, _HITS)], names=batch.schema.names)

        out = out.mapInArrow(shards.trimmed(run), T.StructType([*kept.schema.fields, T.StructField("hits", out.schema["hits"].dataType)]))
    return out


def query(spark, sf_dir):
    """op7: (document, benchmark item) pairs with the best matching window."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.start_word", "hit.n_words", "hit.edits")
