"""Windows of symbols that repeat across a corpus: seeds by winnowing, groups by seed.

A window is ``window`` consecutive symbols (bytes, or words as 64-bit hashes) of one
document. Its seed is the smallest hash among its runs of ``seed`` symbols, so equal windows
have their seed at the same place. The segment of a seed is all windows that contain it.

1. Tasks winnow the texts and send each distinct seed once (with the smallest and largest
   segment hash and the earliest place). Reducers keep seeds that occur twice or more, as
   sorted hash arrays: in one segment only (kind 1), in several (kind 2), or in so many that
   one task should not see them all (kind 3).
2. For seeds of kinds 2 and 3 each distinct segment is sent with its symbols to the shard of
   its seed, or, for kind 3, to any shard. A method of the caller finds the classes of equal
   windows there. Kind 2 is then decided: each segment's earliest place gets a mask of the
   windows that start earlier elsewhere. The classes of kind 3 are merged by window hash.
3. Tasks go over the texts again, look their seeds up and mark what is to go.

A seed in a third of all documents is one row of each task in step 1, and its segments are
spread over all shards in step 2. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shards

#: Distinct segments of a seed from which its groups are spread over shards.
HOT = 4096
#: Symbols of segments whose classes are found at once.
PIECE = 1 << 20
#: Seeds that a task gathers before it sends them on.
SEEDS = 1 << 17
#: Bytes of text that are winnowed at once; one less than a power of two, as powers are tabled.
CHUNK = (1 << 18) - 1
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TABLES = np.random.default_rng(7).integers(0, 2**64, (2, 256), dtype=np.uint64)
_POWERS: dict = {}
_SEGMENTS = pa.schema([("shard", pa.int32()), ("data", pa.binary()), ("content", pa.binary())])
_KINDS = "u8", "u8", "i8", "i8", "u2", "u2", "u1"  # seed, segment, doc, place, symbols before the seed, symbols, kind


@dataclass(frozen=True)
class Method:
    """How symbols are read and how equal windows of segments are found."""

    window: int
    seed: int
    #: texts -> (symbols, length of each text)
    symbols: Callable
    #: (content, segment lengths, symbols before the seed, seed group) -> (segment, offset, class) of each window, by class
    classes: Callable
    #: Whether an earlier start in the same document counts too.
    within: bool

    @property
    def reach(self) -> int:
        return self.window - self.seed


def _powers(n: int, base: int):
    """Powers of a base and of its inverse modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        b = int(_BASES[base])
        out = []
        for factor in (b, pow(b, -1, 1 << 64)):
            size, p = 1, np.ones(1, np.uint64)
            while size < n:
                p = np.concatenate([p, p * np.uint64(pow(factor, size, 1 << 64))])
                size *= 2
            out.append(p)
        _POWERS[base] = out
    return _POWERS[base]


class Rolling:
    """Hash of any run of symbols in constant time: sums of symbol values times powers."""

    def __init__(self, symbols: np.ndarray, base: int):
        value = _TABLES[base][symbols] if symbols.dtype == np.uint8 else shards.mix(symbols + _BASES[base])
        self.up, down = _powers(len(symbols) + 1, base)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(value * down[: len(symbols)], out=self.sums[1:])

    def run(self, start, end):
        return shards.mix((self.sums[end] - self.sums[start]) * self.up[start])

    def every(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return shards.mix((self.sums[width:] - self.sums[:n]) * self.up[:n])


def sliding(values: np.ndarray, width: int, function) -> np.ndarray:
    """``function`` (minimum or maximum) over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = function(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return function(values[:-rest], values[rest:]) if rest else values


@dataclass
class Seeds:
    """The seeds of a chunk of texts and their segments, as arrays."""

    at: np.ndarray
    seed: np.ndarray
    segment: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    rolling: Rolling

    def place(self):
        return self.at - self.starts[self.text]


def winnow(symbols: np.ndarray, sizes: np.ndarray, method: Method) -> Seeds:
    """Every position that holds the smallest run hash of a window (all of them, if tied)."""
    w, reach = method.window, method.reach
    ends = np.cumsum(sizes)
    starts = ends - sizes
    second = Rolling(symbols, 1)
    hashes = Rolling(symbols, 0).every(method.seed)
    np.maximum(hashes, np.uint64(1), out=hashes)
    chosen = np.empty(0, np.int64)
    if len(symbols) >= w:
        least = sliding(hashes, reach + 1, np.minimum)
        inside = np.zeros(len(symbols) + 1, np.int32)
        long = sizes >= w
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - w + 1, -1)
        least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint64(0))
        pad = np.zeros(reach, np.uint64)
        chosen = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), reach + 1, np.maximum) == hashes)
    text = np.searchsorted(ends, chosen, side="right")
    low = np.maximum(starts[text], chosen - reach)
    high = np.minimum(ends[text], chosen + w)
    segment = shards.mix(second.run(low, high) ^ ((chosen - low).astype(np.uint64) << np.uint64(32)) ^ (high - low).astype(np.uint64))
    # Smallest hashes crowd at the low end; mixed again they spread over all shards.
    return Seeds(chosen, shards.mix(hashes[chosen] ^ _BASES[0]), segment, low, high, text, starts, second)


def _route(seed, segment, kind):
    """What a segment's shard is taken from."""
    return np.where(kind == 3, shards.mix(seed ^ shards.mix(segment)), seed)


def _segment_key(seed, segment, kind, bits: int):
    """Key of a segment in its shard: the shard's bits, then those of the segment's hash."""
    top = np.uint64((1 << bits) - 1) << np.uint64(64 - bits)
    return (_route(seed, segment, kind) & top) | (segment >> np.uint64(bits))


def _firsts(*keys):
    """The order by the keys (most significant first) and where a new pair of the first two begins."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, int)


class Repeats:
    """The lookup arrays of steps 1 and 2, in the shared folder."""

    def __init__(self, folder: str, bits: int, method: Method):
        self.method, self.bits = method, bits
        self.seeds = shards.Mapped(folder, bits, "seed")
        self.segments = shards.Mapped(folder, bits, "segment")
        self.windows = shards.Mapped(folder, bits, "window")

    def kinds(self, seeds: Seeds):
        """Kind, document and place of each seed (kind 0: it occurs once)."""
        order = np.argsort(seeds.seed)
        out = []
        for found in self.seeds.find(seeds.seed[order], "seed_kind", "seed_doc", "seed_place")[1:]:
            back = np.empty_like(found)
            back[order] = found
            out.append(back)
        return out

    def marks(self, symbols: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each symbol is covered by a window that starts earlier."""
        method, w = self.method, self.method.window
        seeds = winnow(symbols, sizes, method)
        kind, doc, place = self.kinds(seeds)
        own, at = ids[seeds.text], seeds.place()

        def later(doc, place, than_doc, than_place):
            return (doc > than_doc) | (method.within & (doc == than_doc) & (place > than_place))

        whole = (kind == 1) & later(own, at, doc, place)
        low, high = [seeds.low[whole]], [seeds.high[whole]]
        several = np.flatnonzero(kind == 2)
        keys = _segment_key(seeds.seed[several], seeds.segment[several], kind[several], self.bits)
        order = np.argsort(keys)
        several = several[order]
        found, doc, place, *masks = self.segments.find(keys[order], "segment_doc", "segment_place", *(f"segment_mask{i}" for i in range(-(-(method.reach + 1) // 64))))
        whole = found & later(own[several], at[several], doc, place)
        low.append(seeds.low[several[whole]])
        high.append(seeds.high[several[whole]])
        first = found & ~whole & (own[several] == doc) & (not method.within or at[several] == place)
        for i, mask in enumerate(masks):
            rest = first & (mask != 0)
            bit = np.unpackbits(mask[rest].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            which, offset = np.nonzero(bit)
            start = seeds.low[several[rest]][which] + offset + 64 * i
            low.append(start)
            high.append(start + w)
        hot = np.flatnonzero(kind == 3)
        if len(hot):
            n = seeds.high[hot] - seeds.low[hot] - w + 1
            start = np.unique(np.repeat(seeds.low[hot] - np.cumsum(n) + n, n) + np.arange(n.sum()))
            key, check = seeds.rolling.run(start, start + w), Rolling(symbols, 0).run(start, start + w)
            order = np.argsort(key)
            start = start[order]
            found, same, doc, place = self.windows.find(key[order], "window_check", "window_doc", "window_place")
            text = np.searchsorted(np.cumsum(sizes), start, side="right")
            gone = found & (same == check[order]) & later(ids[text], start - seeds.starts[text], doc, place)
            low.append(start[gone])
            high.append(start[gone] + w)
        change = np.zeros(len(symbols) + 1, np.int32)
        np.add.at(change, np.concatenate(low), 1)
        np.add.at(change, np.concatenate(high), -1)
        return np.cumsum(change)[:-1] > 0


def pieces(batch: pa.RecordBatch):
    """Slices of a batch (id, text): its rows, all texts, and which have an id, with those ids."""
    column = batch.column(1).cast(pa.binary())
    for i, j in shards.chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), CHUNK):
        ids = batch.column(0)[i:j]
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        which = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        yield batch.slice(i, j - i), shards.texts_of(column[i:j]), which, numbers[which]


def _with_ids(batch: pa.RecordBatch):
    for _, texts, which, ids in pieces(batch):
        yield ids, [texts[i] for i in which]


def find_repeats(docs: DataFrame, method: Method) -> Repeats:
    """Steps 1 and 2 over documents (doc_id, text); rows without an id take no part."""
    spark = docs.sparkSession
    folder, bits = shards.shared_folder(spark, "repeats"), shards.shard_bits(spark)
    kinds = "u8", "u8", "u8", "i8", "i8", "u4", "?"

    def merge(seed, low, span, doc, place, parts, many):
        order = np.lexsort((place, doc, seed))
        seed, low, span, doc, place, parts, many = (x[order] for x in (seed, low, span, doc, place, parts, many))
        new = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]]) if len(seed) else np.empty(0, int)
        if not len(new):
            return seed, low, span, doc, place, parts, many
        least, most = np.minimum.reduceat(low, new), np.maximum.reduceat(low ^ span, new)
        several = np.logical_or.reduceat(many, new) | (np.diff(np.r_[new, len(seed)]) > 1)
        return seed[new], least, least ^ most, doc[new], place[new], np.add.reduceat(parts, new, dtype=np.uint32), several

    def gathered(parts):
        found = merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return shards.cut(bits, found[0], *found)

    def send_seeds(batches):
        for batch in batches:
            parts, held = [], 0
            for ids, texts in _with_ids(batch):
                symbols, sizes = method.symbols(texts)
                s = winnow(symbols, sizes, method)
                order, new = _firsts(s.seed, s.segment, ids[s.text], s.place())
                many = np.diff(np.r_[new, len(order)]) > 1
                order = order[new]
                n = len(order)
                parts.append(merge(s.seed[order], s.segment[order], np.zeros(n, np.uint64), ids[s.text[order]], s.place()[order], np.ones(n, np.uint32), many))
                held += n
                if held >= SEEDS:
                    yield gathered(parts)
                    parts, held = [], 0
            if parts:
                yield gathered(parts)

    def keep_seeds(shard, rows):
        seed, _, span, doc, place, parts, many = merge(*shards.unpack(rows, *kinds))
        kind = np.where(span == 0, 1, np.where(parts <= HOT, 2, 3)).astype(np.uint8)
        for name, array in (("seed_kind", kind), ("seed_doc", doc), ("seed_place", place), ("seed", seed)):
            shards.save(f"{folder}/{name}-{shard}.npy", array[many])
        return pa.RecordBatch.from_arrays([pa.array([int(((kind > 1) & many).sum())])], names=["n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = shards.reduce_shards(rows.mapInArrow(send_seeds, shards.BLOCK), keep_seeds, "n long").agg(F.sum("n")).first()[0]
    repeats = Repeats(folder, bits, method)
    if not several:
        return repeats

    def send_segments(batches):
        for batch in batches:
            for ids, texts in _with_ids(batch):
                symbols, sizes = method.symbols(texts)
                s = winnow(symbols, sizes, method)
                kind = repeats.kinds(s)[0]
                use = np.flatnonzero(kind > 1)
                order, new = _firsts(s.seed[use], s.segment[use], ids[s.text[use]], s.place()[use])
                use = use[order[new]]
                route = _route(s.seed[use], s.segment[use], kind[use])
                use = use[np.argsort(route, kind="stable")]
                route.sort()
                n = s.high[use] - s.low[use]
                content = symbols[np.repeat(s.low[use] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                ends = np.r_[0, np.cumsum(n)]
                columns = s.seed[use], s.segment[use], ids[s.text[use]], s.place()[use], (s.at - s.low)[use].astype(np.uint16), n.astype(np.uint16), kind[use].astype(np.uint8)
                shard = (route >> np.uint64(64 - bits)).astype(np.int32)
                parts = shards.runs(shard)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard[i] for i, _ in parts], pa.int32()),
                        pa.array([shards.pack(*(c[i:j] for c in columns)) for i, j in parts], pa.binary()),
                        pa.array([content[ends[i] : ends[j]].tobytes() for i, j in parts], pa.binary()),
                    ],
                    schema=_SEGMENTS,
                )

    symbol = method.symbols([b"a"])[0].dtype

    def decide(key, table):
        shard = key[0].as_py()
        seed, segment, doc, place, before, size, kind = shards.unpack(table.column("data").to_pylist(), *_KINDS)
        content = np.frombuffer(b"".join(table.column("content").to_pylist()), symbol)
        size = size.astype(np.int64)
        starts = np.cumsum(size) - size
        order, new = _firsts(seed, segment, doc, place)
        order = order[new]
        seed, segment, doc, place, before, size, kind, starts = (x[order] for x in (seed, segment, doc, place, before, size, kind, starts))
        words = -(-(method.reach + 1) // 64)
        masks = np.zeros((words, len(seed)), np.uint64)
        merged = [[], [], [], []]
        group = np.cumsum(np.r_[0, seed[1:] != seed[:-1]]) if len(seed) else np.empty(0, int)
        # Pieces end where a seed's group does, if it is not a piece of its own.
        piece = np.cumsum(size) // PIECE
        piece = piece[np.searchsorted(group, group)] if len(seed) else piece
        for i, j in shards.runs(piece):
            n = size[i:j]
            part = content[np.repeat(starts[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            which, offset, cls = method.classes(part, n, before[i:j].astype(np.int64), group[i:j])
            begin = place[i:j][which] - before[i:j][which].astype(np.int64) + offset
            mine = doc[i:j][which]
            order = np.lexsort((begin, mine, cls))
            which, offset, cls, begin, mine = (x[order] for x in (which, offset, cls, begin, mine))
            new = np.r_[True, cls[1:] != cls[:-1]] if len(cls) else np.empty(0, bool)
            first = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            gone = (mine > mine[first][of]) | (method.within & (begin > begin[first][of])) if len(cls) else new
            np.bitwise_or.at(masks, (offset[gone] // 64, i + which[gone]), np.uint64(1) << (offset[gone] % 64).astype(np.uint64))
            hot = first[kind[i:j][which[first]] == 3]
            if len(hot):
                at = (np.cumsum(n) - n)[which[hot]] + offset[hot]
                for into, x in zip(merged, (Rolling(part, 1).run(at, at + method.window), Rolling(part, 0).run(at, at + method.window), mine[hot], begin[hot]), strict=True):
                    into.append(x)
        several = kind == 2
        keys = _segment_key(seed, segment, kind, bits)[several]
        order = np.argsort(keys)
        for name, array in (("doc", doc), ("place", place), *((f"mask{i}", m) for i, m in enumerate(masks))):
            shards.save(f"{folder}/segment_{name}-{shard}.npy", array[several][order])
        shards.save(f"{folder}/segment-{shard}.npy", keys[order])
        if not merged[0]:
            return pa.table({"shard": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        columns = [np.concatenate(x) for x in merged]
        order = np.argsort(columns[0])
        columns = [x[order] for x in columns]
        return pa.Table.from_batches([shards.cut(bits, columns[0], *columns)])

    def keep_windows(shard, rows):
        key, check, doc, place = shards.unpack(rows, "u8", "u8", "i8", "i8")
        order = np.lexsort((place, doc, key))
        order = order[np.r_[True, key[order][1:] != key[order][:-1]]]
        for name, array in (("window_check", check), ("window_doc", doc), ("window_place", place), ("window", key)):
            shards.save(f"{folder}/{name}-{shard}.npy", array[order])
        return pa.RecordBatch.from_arrays([pa.array([len(order)])], names=["n"])

    decided = rows.mapInArrow(send_segments, "shard int, data binary, content binary").groupBy("shard").applyInArrow(decide, shards.BLOCK)
    shards.reduce_shards(decided, keep_windows, "n long").agg(F.sum("n")).collect()
    return repeats
