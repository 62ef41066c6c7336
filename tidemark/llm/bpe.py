"""BPE encoding and decoding through a table of distinct words.

No token of the supported tokenizers reaches over white space, so a text's ids are the ids of
its words, one after the other. Tasks split the texts, keep each word once and send it to the
shard of its hash; each distinct word is encoded once, by the tokenizer itself; the ids come
back by position: a task looks up the distinct words of a chunk in the sorted hash arrays and
lays their ids out in text order. Words whose 64-bit hashes clash are left out of the table
and encoded where they occur. Decoding is a join of ids to pieces.

Frequent words are no hot keys, since each task sends a word once.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import shards

#: Words that a task holds before it sends them on.
WORDS = 1 << 18
_SENT = pa.schema([("shard", pa.int32()), ("data", pa.binary())])


def read_tokenizer(path: str) -> str:
    """The tokenizer's file as text, checked to be one that this method can encode."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    tokenizer = Tokenizer.from_str(text)
    parts = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("a b\n c", "a", "b", "c")]
    if parts[0] != parts[1] + parts[2] + parts[3]:
        raise ValueError(f"{path}: tokens depend on white space, so words can't be encoded one by one")
    return text


def _tokenizer(text: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoded(tokenizer: Tokenizer, words: list[bytes]) -> list[list[int]]:
    out = []
    for i in range(0, len(words), 4096):
        batch = [w.decode() for w in words[i : i + 4096]]
        out += [e.ids for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_table(docs: DataFrame, tokenizer: str, text_col="text") -> shards.Mapped:
    """Encodes each distinct word once: sorted hashes, and where its ids start and end."""
    spark = docs.sparkSession
    shards.small_batches(spark)
    folder, bits = shards.shared_folder(spark, "words"), shards.shard_bits(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def send(words):
        keys = _hashes(words)
        order = np.argsort(keys)
        shard = (keys[order] >> np.uint64(64 - bits)).astype(np.int32)
        parts = shards.runs(shard)
        rows = [b" ".join(words[k] for k in order[i:j]) for i, j in parts]
        return pa.RecordBatch.from_arrays([pa.array([shard[i] for i, _ in parts], pa.int32()), pa.array(rows, pa.binary())], schema=_SENT)

    def split(batches):
        words: set[bytes] = set()
        for batch in batches:
            for text in shards.texts_of(batch.column(0)):
                words.update(text.split())
                if len(words) >= WORDS:
                    yield send(list(words))
                    words = set()
        if words:
            yield send(list(words))

    def encode(shard, rows):
        words = list(set().union(*(row.split(b" ") for row in rows)))
        keys = _hashes(words)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        twice = np.r_[False, keys[1:] == keys[:-1]]
        once = ~(twice | np.r_[twice[1:], False])
        ids = _encoded(_tokenizer(shared.value), [words[k] for k in order[once]])
        ends = np.cumsum([len(x) for x in ids], dtype=np.uint32)
        flat = np.fromiter((i for x in ids for i in x), np.uint32)
        if not len(flat) or flat.max() < 1 << 16:
            flat = flat.astype(np.uint16)
        for name, array in (("ids", flat), ("ends", ends), ("keys", keys[once])):
            shards.save(f"{folder}/{name}-{shard}.npy", array)
        return pa.RecordBatch.from_arrays([pa.array([int(once.sum())])], names=["words"])

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(shards.trimmed(split), shards.BLOCK)
    shards.reduce_shards(sent, encode, "words long").agg(F.sum("words")).collect()
    return shards.Mapped(folder, bits)


def _lookup(table: shards.Mapped, words: list[bytes], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these words, one after the other, and how many each has."""
    keys = _hashes(words)
    order = np.argsort(keys)
    keys = keys[order]
    shard = (keys >> np.uint64(64 - table.bits)).astype(np.int64)
    sizes, parts = np.zeros(len(keys), np.int64), []
    for i, j in shards.runs(shard):
        have, ends, ids = (table.array(name, int(shard[i])) for name in ("keys", "ends", "ids"))
        at = np.minimum(np.searchsorted(have, keys[i:j]), max(0, len(have) - 1))
        hit = have[at] == keys[i:j] if len(have) else np.zeros(j - i, bool)
        last = ends[at].astype(np.int64) if len(have) else at
        first = np.where(at > 0, ends[at - 1], 0).astype(np.int64) if len(have) else at
        sizes[i:j] = np.where(hit, last - first, -1)
        n = np.where(hit, last - first, 0)
        parts.append(ids[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.uint32))
    lost = np.flatnonzero(sizes < 0)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if len(lost):
        new = _encoded(tokenizer(), [words[order[k]] for k in lost])
        sizes[lost] = 0
        starts = np.cumsum(sizes) - sizes
        flat = np.insert(flat, np.repeat(starts[lost], [len(x) for x in new]), [i for x in new for i in x])
        sizes[lost] = [len(x) for x in new]
    # Back from hash order to the order of the words.
    starts, place = np.cumsum(sizes) - sizes, np.argsort(order)
    n = sizes[place]
    return flat[np.repeat(starts[place] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def encode(docs: DataFrame, tokenizer: str, text_col="text") -> DataFrame:
    """Adds ``ids``: the text's ids as little-endian unsigned 32-bit integers.

    A NULL or empty text, or one of white space only, has no ids. A column that is already
    named ``ids`` is replaced; all others pass through, repeated rows as often as they come.
    """
    table = word_table(docs, tokenizer, text_col)
    kept = docs.select([c for c in docs.columns if c != "ids"])
    shared, at = docs.sparkSession.sparkContext.broadcast(tokenizer), kept.columns.index(text_col)

    def fill(batches):
        known: list[Tokenizer] = []

        def own():
            if not known:
                known.append(_tokenizer(shared.value))
            return known[0]

        for batch in batches:
            column = batch.column(at).cast(pa.binary())
            for i, j in shards.chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                index: dict[bytes, int] = {}
                place, counts = [], []
                for text in shards.texts_of(column[i:j]):
                    words = text.split()
                    counts.append(len(words))
                    place += [index.setdefault(w, len(index)) for w in words]
                ids, sizes = _lookup(table, list(index), own)
                starts, use = np.cumsum(sizes) - sizes, np.array(place, np.int64)
                n = sizes[use]
                ids = ids[np.repeat(starts[use] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype("<u4")
                ends = np.r_[0, np.cumsum(n)][np.cumsum(counts)]
                out = [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(shards.trimmed(fill), T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded``: the pieces of ``ids``, joined as the tokenizer without a decoder does.

    Ids without a piece are left out; NULL ids decode to the empty text.
    """
    shards.small_batches(encoded.sparkSession)
    vocabulary = Tokenizer.from_str(tokenizer).get_vocab(with_added_tokens=True)
    shared = encoded.sparkSession.sparkContext.broadcast({i: piece for piece, i in vocabulary.items()})
    kept = encoded.select([c for c in encoded.columns if c != "decoded"])
    at = kept.columns.index("ids")

    def join(batches):
        pieces = shared.value
        for batch in batches:
            column = batch.column(at)
            for i, j in shards.chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                texts = [" ".join(pieces[k] for k in np.frombuffer(x or b"", "<u4").tolist() if k in pieces) for x in column[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(shards.trimmed(join), T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir, path: str | None = None):
    """op5: ids of every document and the text that they decode to, as digests."""
    tokenizer = read_tokenizer(path or public_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs, tokenizer).select("doc_id", "ids"), tokenizer)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
