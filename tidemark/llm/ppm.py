"""Language identification by partial matching.

For each language a tree of byte contexts up to ``order`` bytes holds how often each byte
followed. The cost of a byte is ``-log2`` of its share in the longest context that was seen;
a byte not seen there pays the escape of that context (method C: the number of distinct
followers) and is looked up one byte shorter, down to a uniform byte. Statistics are frozen
after training, so a text's code length is a sum over its bytes, and all languages are costed
by one table: (longest known context, byte) -> bits in each language.

Training is Spark's: texts are counted in tasks and summed by key. The sample is bounded by
``sample_chars`` characters for each language, taken by a hash of the id, and the table by
``cells``; both are model parameters and do not touch which rows are predicted. The table is
written to the shared folder block by block and mapped into memory by the tasks, so neither
the driver nor a worker holds a copy of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shards

ORDER = 3
SAMPLE_CHARS = 4_000_000
CELLS = 24_000_000
_ROWS = 1024  # contexts whose shares are computed at once
_LETTER = regex.compile(r"\p{L}")
_PAD = b"   "
_GRAMS = pa.schema([("lang", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


class ContextModel:
    """Frozen costs: row ``state * width + symbol`` of ``costs`` has the bits for each language.

    ``states`` and ``costs`` are files in ``folder``, opened where the model is used.
    """

    def __init__(self, languages: list[str], symbol: np.ndarray, width: int, folder: str):
        self.languages, self.symbol, self.width, self.folder = languages, symbol, width, folder
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _array(self, name: str) -> np.ndarray:
        if name not in self._open:
            self._open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self._open[name]

    @property
    def states(self) -> np.ndarray:
        return self._array("states")

    @property
    def costs(self) -> np.ndarray:
        return self._array("costs")

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, j in shards.chunks([len(x) for x in texts], 1 << 18):
            data = np.frombuffer(_PAD + _PAD.join(texts[i:j]), np.uint8)
            s = self.symbol[data].astype(np.int64)
            state = self.states[(s[:-3] * self.width + s[1:-2]) * self.width + s[2:-1]]
            cost = self.costs[state * self.width + s[3:]]
            sizes = np.array([len(x) for x in texts[i:j]])
            starts = np.cumsum(sizes + 3) - sizes - 3
            sums = np.zeros((len(cost) + 1, cost.shape[1]))
            np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
            out[i:j] = sums[starts + sizes] - sums[starts]
        return out


def _build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, cells: int, folder: str) -> ContextModel:
    """Costs from counts of byte runs of four (three of context, one that followed)."""
    grams = gram.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, ::-1]  # in reading order
    used = np.unique(np.r_[grams.ravel(), np.frombuffer(_PAD, np.uint8)])
    symbol = np.full(256, len(used), np.uint16)
    symbol[used] = np.arange(len(used))
    width, k = len(used) + 1, len(languages)
    g = symbol[grams].astype(np.int64)
    room = max(0, cells // (width * k) - width)
    states = np.tile(np.arange(width, dtype=np.int32), width * width)  # the last byte alone

    # The most frequent contexts of two and three bytes get a row, up to half of the room each.
    depths = []
    for key in (g[:, 2] + g[:, 1] * width, g[:, 2] + (g[:, 1] + g[:, 0] * width) * width):
        keys, where = np.unique(key, return_inverse=True)
        keep = np.sort(np.lexsort((keys, -np.bincount(where, n)))[: room // 2])
        row = np.full(len(keys), -1)
        row[keep] = np.arange(len(keep))
        depths.append((keys[keep], row[where]))
    total = width + sum(len(keys) for keys, _ in depths)
    costs = np.lib.format.open_memmap(f"{folder}/costs.npy", "w+", np.float32, (total * width, k))
    table = costs.reshape(total, width, k)

    def blend(counts, shorter):
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(counts > 0, counts / (total + kinds), kinds / (total + kinds) * shorter)
        return np.where(total > 0, p, shorter)

    def fill(first, row, count, shorter):
        """Shares of the contexts from row ``first`` on, ``_ROWS`` contexts at a time."""
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(0, count + _ROWS, _ROWS))
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            low, size, mine = i * _ROWS, min(_ROWS, count - i * _ROWS), order[a:b]
            at = ((row[mine] - low) * width + g[mine, 3]) * k + lang[mine]
            counts = np.bincount(at, n[mine], size * width * k).reshape(size, width, k)
            table[first + low : first + low + size] = blend(counts, shorter(slice(low, low + size)))

    at = (g[:, 3] * k + lang, n, width * k)
    p0 = blend(np.bincount(*at).reshape(1, width, k), np.full((1, width, k), 1 / 256))
    fill(0, g[:, 2], width, lambda _: p0)
    first = width
    for depth, (keys, row) in enumerate(depths, 2):
        under = states[keys]
        fill(first, row, len(keys), lambda part, under=under: table[under[part]])
        into = states.reshape(width, width * width) if depth == 2 else states
        into[..., keys] = first + np.arange(len(keys))
        first += len(keys)
    for i in range(0, total, _ROWS):
        table[i : i + _ROWS] = -np.log2(table[i : i + _ROWS])
    costs.flush()
    shards.save(f"{folder}/states.npy", states)
    return ContextModel(languages, symbol, width, folder)


def train(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample_chars=SAMPLE_CHARS, cells=CELLS):
    """A ``ContextModel`` of rows with text and language; None if there is no such row."""
    shards.small_batches(labelled.sparkSession)
    rows = labelled.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.create_map(*(F.lit(v) for x in languages for v in (x, min(1.0, sample_chars / max(1, sizes[x])))))
    number = F.create_map(*(F.lit(v) for i, x in enumerate(languages) for v in (x, i)))
    draw = (F.xxhash64(F.coalesce("id", F.lit(""))) / F.lit(2.0**64)) + F.lit(0.5)
    sample = rows.where(draw < share[F.col("lang")]).select(number[F.col("lang")].cast("int").alias("lang"), "text")

    def count(batches):
        for batch in batches:
            lang, texts = batch.column(0).to_numpy(), shards.texts_of(batch.column(1))
            for x in np.unique(lang):
                own = [t for t, y in zip(texts, lang, strict=True) if y == x]
                for i, j in shards.chunks([len(t) for t in own]):
                    data = np.frombuffer(_PAD + _PAD.join(own[i:j]), np.uint8).astype(np.int64)
                    grams, n = np.unique((data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), x, np.int32)), pa.array(grams), pa.array(n)], schema=_GRAMS)

    counts = sample.mapInArrow(shards.trimmed(count), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    lang, gram, n = (counts.column(c).to_numpy() for c in ("lang", "gram", "n"))
    order = np.lexsort((gram, lang))
    folder = shards.shared_folder(labelled.sparkSession, "contexts")
    return _build(languages, lang[order].astype(np.int64), gram[order], n[order], cells, folder)


def identify(docs: DataFrame, model: ContextModel | None, text_col="text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to each row.

    ``score`` is the posterior of the best language under equal priors; equal code lengths go
    to the first language by name. A NULL text, an empty one and one without a letter are
    ``und`` with score 0, and so is every row when there is no model. Columns that already
    have these names are replaced; all other columns pass through.
    """
    shards.small_batches(docs.sparkSession)
    made = ("lang_pred", "score")
    kept = docs.select([c for c in docs.columns if c not in made])
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def predict(batches):
        m = shared.value
        for batch in batches:
            texts = shards.texts_of(batch.column(at))
            bits = m.bits(texts)
            best = bits.argmin(1) if len(texts) else np.empty(0, int)
            odds = np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)) if len(texts) else bits
            score = 1 / odds.sum(1)
            letters = np.array([bool(_LETTER.search(t.decode())) for t in texts], bool)
            names = [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            more = [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *made])

    return kept.mapInArrow(shards.trimmed(predict), schema)


def query(spark, sf_dir):
    """op10: the language of every document, learned from two thirds of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~shards.crc_is(F.col("doc_id"), 3, 1)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", shards.crc_is(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score"
    )
