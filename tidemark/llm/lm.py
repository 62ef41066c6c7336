"""Language-model scores: interpolated modified Kneser-Ney over word pairs.

Counting is Spark's. Tasks hash words, count pairs (context, word) and send each pair once to
the shard of its context; contexts that are frequent anywhere (a set of bounded size) are
spread over all shards by pair. A reducer writes the shard's pairs as a sorted hash array
with counts, and for each context its total and how many words followed once, twice, or more
often. In the same job the number of distinct contexts of each word goes to the shard of that
word. The driver sees counts of counts, a few numbers for each shard.

Scoring tasks map the arrays into memory, look up the distinct pairs and words of a chunk,
and add up log probabilities by document. The arrays grow with the corpus; workers hold none
of them.

The order of the model is two: contexts are one word, or the start of the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shards

#: Pairs that a task counts before it sends them on.
PAIRS = 1 << 21
#: A context is spread over all shards from this share of all tokens.
HOT_SHARE = 1e-3
#: Words hold no white space, so these are no words.
START, END = (np.uint64(x) for x in shards.hash_words([b" start", b" end"], {}))
_SCORED = (("n_tokens", "i8"), ("n_known", "i8"), ("base_score", "f8"), ("score", "f8"))


def tokens(texts: list[bytes], known: dict[bytes, int]):
    """Hashes of (previous token, token) over all texts, and the number of tokens of each."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    hashed = shards.hash_words([w for x in words for w in x], known)
    ends = np.cumsum(sizes)
    token = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends - 1] = False
    token[inner] = hashed
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - sizes] = START
    return before, token, sizes


def _pair(before, token):
    return shards.mix(before * np.uint64(0x9E3779B97F4A7C15) ^ shards.mix(token))


def _in(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


def _keys(before, token, hot: np.ndarray, bits: int):
    """Key of a pair: the shard's bits, from its context or itself, then those of its hash."""
    pair = _pair(before, token)
    spread = _in(before, hot)
    top = np.uint64((1 << bits) - 1) << np.uint64(64 - bits)
    return (np.where(spread, pair, before) & top) | (pair >> np.uint64(bits))


def _summed(keys: tuple[np.ndarray, ...], *values: np.ndarray):
    """Distinct keys in order, and the sums of the values over each."""
    order = np.lexsort(keys[::-1])
    keys, values = [k[order] for k in keys], [v[order] for v in values]
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v, at, dtype=v.dtype) if len(at) else v for v in values]


def _counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(n == i) for i in (1, 2, 3, 4)], np.int64)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and 3 or more; (0.5, 1, 1.5) where they can't be estimated."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if min(n1, n2, n3) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, 0, [0, 1, 2, 3]) if (found[1:] > 0).all() else np.array([0, 0.5, 1.0, 1.5])


@dataclass
class PairModel:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    bits: int
    hot: np.ndarray
    hot_stats: np.ndarray  # by hot context: total, words seen once, twice, more often
    train_tokens: int
    distinct: int
    pairs: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_rest: float

    def __post_init__(self):
        self.by_pair, self.by_large, self.by_context, self.by_word = (shards.Mapped(self.folder, self.bits, x) for x in ("pair", "large", "context", "word"))

    def words(self, hashes: np.ndarray):
        """For sorted distinct tokens: total as context (which is its count), 1/2/3+ followers, contexts."""
        stats = np.stack([x.astype(np.int64) for x in self.by_context.find(hashes, "context_n", "context_n1", "context_n2", "context_n3")[1:]])
        at = np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)
        hot = self.hot[at] == hashes
        stats[:, hot] = self.hot_stats[at[hot]].T
        return stats, self.by_word.find(hashes, "word_n")[1].astype(np.int64)

    def score(self, texts: list[bytes], known: dict[bytes, int]):
        """n_tokens, n_known, base_score and score of each text."""
        before, token, sizes = tokens(texts, known)
        hashes, place = np.unique(np.concatenate([before, token]), return_inverse=True)
        stats, contexts = self.words(hashes)
        u, w = place[: len(token)], place[len(token) :]
        # The end of a text is counted as the start is: once in each document.
        count = np.where(token == END, stats[0][u[np.cumsum(sizes) - sizes][0]] if len(token) else 0, stats[0][w])
        base = np.log10((count + 1) / (self.train_tokens + self.distinct + 1))
        n1 = self._share(contexts, self.pairs, self.word_discounts)
        p_word = (n1 + self.word_rest / (self.distinct + 1))[w]
        total = stats[0][u]
        d = self.pair_discounts
        rest = np.where(total > 0, (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3])[u] / np.maximum(total, 1), 1.0)
        keys, back = np.unique(_keys(before, token, self.hot, self.bits), return_inverse=True)
        n = self.by_pair.find(keys, "pair_n")[1].astype(np.int64)
        many = np.flatnonzero(n == 255)
        if len(many):
            n[many] = self.by_large.find(keys[many], "large_n")[1]
        n = n[back]
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1) + rest * p_word
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0, x.dtype)
        return sizes, add((count > 0).astype(np.int64)), add(base), add(np.log10(p))

    @staticmethod
    def _share(n, total, d):
        return np.maximum(n - d[np.minimum(n, 3)], 0) / max(total, 1)


def hot_contexts(texts: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Hashes of words that make up ``share`` of the tokens somewhere, and the start of a text.

    At most 1 / share words, the most frequent. Any set gives the same model; this one keeps
    shards even.
    """

    def frequent(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            parts = [tokens(shards.texts_of(column[i:j]), known)[1] for i, j in shards.chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist())]
            if parts:
                word, n = np.unique(np.concatenate(parts), return_counts=True)
                most = n >= share * n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(word[most].view(np.int64)), pa.array(n[most])], names=["word", "n"])

    found = texts.mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(math.ceil(1 / share)).collect()]
    return np.unique(np.r_[np.array(words, np.int64).view(np.uint64), START])


def train(docs: DataFrame, text_col="text", share: float = HOT_SHARE) -> PairModel:
    """Counts the texts (NULL is empty) and writes the model into the shared folder."""
    spark = docs.sparkSession
    folder, bits = shards.shared_folder(spark, "pairs"), shards.shard_bits(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    hot = hot_contexts(texts, share)

    def send(batches):
        known: dict[bytes, int] = {}
        held, n = [], 0

        def counted():
            before, token = (np.concatenate(x) for x in zip(*held, strict=True))
            spread = _in(before, hot)
            route = np.where(spread, _pair(before, token), before) >> np.uint64(64 - bits)
            (route, before, token), (count,) = _summed((route, before, token), np.ones(len(token), np.uint32))
            return shards.cut(bits, route << np.uint64(64 - bits), before, token, count)

        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            for i, j in shards.chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                before, token, _ = tokens(shards.texts_of(column[i:j]), known)
                held.append((before, token))
                n += len(token)
                if n >= PAIRS:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    base = 1 << bits  # shards from here on are hot contexts, then counts of counts

    def keep_pairs(key, table):
        shard = key[0].as_py()
        (before, token), (n,) = _summed(tuple((x := shards.unpack(table.column("data").to_pylist(), "u8", "u8", "u4"))[:2]), x[2].astype(np.int64))
        keys = _keys(before, token, hot, bits)
        order = np.argsort(keys)
        large = order[n[order] >= 255]
        for name, array in (("pair_n", np.minimum(n, 255).astype(np.uint8)[order]), ("pair", keys[order]), ("large_n", n[large]), ("large", keys[large])):
            shards.save(f"{folder}/{name}-{shard}.npy", array)
        (context,), stats = _summed((before,), n, *(np.asarray(x, np.int64) for x in (n == 1, n == 2, n >= 3)))
        spread = _in(context, hot)
        for name, array in zip(("context_n", "context_n1", "context_n2", "context_n3", "context"), (*stats, context), strict=True):
            shards.save(f"{folder}/{name}-{shard}.npy", array[~spread])
        (word,), (contexts,) = _summed((token,), np.ones(len(token), np.uint32))
        out = shards.cut(bits, word, word, contexts)
        partial = shards.pack(context[spread], *(x[spread] for x in stats))
        facts = np.r_[_counts_of_counts(n), n.sum(), len(n), np.count_nonzero(~spread)].astype(np.int64).tobytes()
        more = pa.RecordBatch.from_arrays([pa.array([base, base + 1], pa.int32()), pa.array([partial, facts], pa.binary())], schema=out.schema)
        return pa.Table.from_batches([out, more])

    def keep_words(key, table):
        shard, rows = key[0].as_py(), table.column("data").to_pylist()
        if shard == base:
            context, *stats = shards.unpack(rows, "u8", "i8", "i8", "i8", "i8")
            (context,), stats = _summed((context,), *stats)
            facts = shards.pack(context, *stats)
        elif shard > base:
            facts = np.sum([np.frombuffer(x, np.int64) for x in rows], axis=0).tobytes()
        else:
            word, n = shards.unpack(rows, "u8", "u4")
            (word,), (n,) = _summed((word,), n.astype(np.int64))
            shards.save(f"{folder}/word_n-{shard}.npy", n.astype(np.uint32))
            shards.save(f"{folder}/word-{shard}.npy", word)
            facts = np.r_[_counts_of_counts(n), np.count_nonzero(n >= 3)].astype(np.int64).tobytes()
        return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([facts], pa.binary())})

    pairs = texts.mapInArrow(send, shards.BLOCK).groupBy("shard").applyInArrow(keep_pairs, shards.BLOCK)
    facts = {r["shard"]: bytes(r["data"]) for r in pairs.groupBy("shard").applyInArrow(keep_words, shards.BLOCK).collect()}
    numbers = np.frombuffer(facts.pop(base + 1, bytes(56)), np.int64)
    context, *stats = shards.unpack([facts.pop(base, b"")], "u8", "i8", "i8", "i8", "i8")
    of_hot = np.zeros((len(hot), 4), np.int64)
    of_hot[np.searchsorted(hot, context)] = np.stack(stats, 1)
    words = np.sum([np.frombuffer(x, np.int64) for x in facts.values()], axis=0) if facts else np.zeros(5, np.int64)
    n_pairs = int(numbers[5])
    d = discounts(words[:4])
    rest = float(d[1] * words[0] + d[2] * words[1] + d[3] * words[4]) / n_pairs if n_pairs else 1.0
    # Contexts are all words and the start, tokens all words and the end: as many.
    distinct = int(numbers[6]) + int(np.count_nonzero(of_hot[:, 0]))
    return PairModel(folder, bits, hot, of_hot, int(numbers[4]), distinct, n_pairs, discounts(numbers[:4]), d, rest)


def score(docs: DataFrame, model: PairModel, text_col="text") -> DataFrame:
    """Adds n_tokens, n_known, base_score and score (log10 probabilities of the whole text).

    A NULL or empty text is the end token alone. With nothing learned every score is 0.
    Columns that already have these names are replaced.
    """
    made = [name for name, _ in _SCORED]
    kept = docs.select([c for c in docs.columns if c not in made])
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            column = batch.column(at).cast(pa.binary())
            for i, j in shards.chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                columns = shared.value.score(shards.texts_of(column[i:j]), known)
                more = [pa.array(x.astype(kind)) for x, (_, kind) in zip(columns, _SCORED, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *more], names=[*batch.schema.names, *made])

    fields = [T.StructField(name, T.LongType() if kind == "i8" else T.DoubleType()) for name, kind in _SCORED]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def query(spark, sf_dir):
    """op1: scores of all documents under a model of those whose id hash is not 2 modulo 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = shards.crc_is(F.col("doc_id"), 7, 2)
    model = train(docs.where(~held))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
