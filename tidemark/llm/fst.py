"""Token counts by a finite-state tokenizer.

A tokenizer that cuts texts by character classes and merges bytes within the pieces is
compiled, transition by transition as texts call for them, into one deterministic transducer
over characters. A transition holds the state after it and the change in the number of tokens
that the text up to there has. Lower-casing is part of the transitions.

*Inside a piece.* The last token of a prefix's encoding is the only token that ends there and
stays apart from the last token before it when the two are merged on their own. So a state
needs, for each place where a token may begin that can still grow, the last token before that
place and how many tokens there were: as far back as the longest suffix that begins some token.
At the end of a piece the last byte becomes one that ends a word, which is looked up alike.

*Long texts.* A chunk of a text is a map from the state before it to the state after it and a
count. All states agree after the first white space, so a map is kept as the characters before
that, the count after it and the last state. Maps compose, and composing is associative: the
chunks of a text are dealt to tasks and composed by a scan of ``FAN`` maps at a time.
"""

from __future__ import annotations

import json
import pickle
import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import shards
from tidemark.llm.bpe import public_path

#: Characters of a chunk, maps that one step of the scan composes, transitions that a task keeps.
CHUNK, FAN, KEEP = 1 << 16, 1 << 8, 1 << 19
#: Rounds of the scan: a value has less than 2**31 bytes.
ROUNDS = 2
#: Fixed value: the pattern of pieces that the transducer's modes stand for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OPEN, _LETTERS, _OTHER, _QUOTE = "open", "letters", "other", "quote"
#: What may follow a quote to make a piece of its own, and what may follow that.
_SHORT, _PAIRS = "stmd", {"r": "e", "v": "e", "l": "l"}
_MARK = 0xD800  # special strings become lone surrogates, which no text holds


class State(dict):
    """A state: by character the state after it and the change in tokens; ``key`` says what it stands for."""

    __slots__ = ("key",)


def read_tokenizer(path: str) -> str:
    """The tokenizer's file as text, checked part by part to be one that can be compiled."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    cut, tail = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[:2] if spec["pre_tokenizer"] else ({}, {})
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    model = spec["model"]
    fits = (
        normal == ["NFC", "Replace", "Lowercase"]
        and cut.get("pattern") == {"Regex": PATTERN} and cut["behavior"] == "Removed" and cut["invert"]
        and tail.get("type") == "ByteLevel" and not tail["add_prefix_space"] and not tail["use_regex"]
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )
    if not fits:
        raise ValueError(f"{path}: only tokenizers that lower-case, cut by {PATTERN} and merge bytes can be compiled")
    return text


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Transducer:
    """The states compiled so far, and how to compile more."""

    def __init__(self, tokenizer: str, keep: int = KEEP):
        spec = json.loads(tokenizer)
        model = spec["model"]
        self.library = Tokenizer.from_str(tokenizer)
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = [tuple(p) for p in pairs]
        self.rank = {p: i for i, p in enumerate(self.merges)}
        self.made = {}
        for i, p in enumerate(self.merges):
            self.made.setdefault("".join(p), i)
        self.vocab = set(model["vocab"])
        stems = {t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab}
        self.prefixes = {t[:k] for t in stems for k in range(len(t) + 1)}
        self.letters = _byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.states, self.size, self.words = {}, 0, {}
        self.edges, self.alones, self.apart_known, self.kinds, self.lowered = {}, {}, {}, {}, {}
        self.start = self.state((_OPEN, None))

    def state(self, key) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.key = key
        return found

    # Inside a piece.

    def merged(self, parts: list[str]) -> list[str]:
        """The pieces' merges, lowest rank first."""
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 30:
                break
            i = ranks.index(least)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def parts(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            stem = token[: -len(self.suffix)]
            return [*stem[:-1], stem[-1] + self.suffix]
        return list(token)

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts of a token that lie at its end (1) or start (0) as it is merged, and the rank that ends each."""
        key = token, side
        if key not in self.edges:
            out, until = [], 1 << 30
            while True:
                out.append((token, until))
                if token not in self.made:
                    break
                until = self.made[token]
                token = self.merges[until][side]
            self.edges[key] = out
        return self.edges[key]

    def alone(self, token: str) -> bool:
        """Whether a token's own letters are merged into it."""
        if token not in self.alones:
            self.alones[token] = self.merged(self.parts(token)) == [token]
        return self.alones[token]

    def apart(self, left: str | None, right: str) -> bool:
        """Whether two tokens stay as they are when one follows the other.

        They do not if a merge over their border comes before the merges that end the two
        parts it joins; of equal ranks the merge further left comes first.
        """
        if left is None:
            return self.alone(right)
        key = left, right
        found = self.apart_known.get(key)
        if found is None:
            rank, found = self.rank, self.alone(right)
            for a, until in self.edge(left, 1) if found else ():
                for b, last in self.edge(right, 0):
                    at = rank.get((a, b))
                    if at is not None and at < until and at <= last:
                        found = False
            self.apart_known[key] = found
        return found

    def last(self, tail: str, back: tuple, end: str) -> tuple[str, int]:
        """The last token after ``tail`` and the number of tokens, relative to the one before its last letter."""
        for at in range(len(tail)):
            token = tail[at:] + end
            if back[at] and token in self.vocab and self.apart(back[at][0], token):
                return token, back[at][1] + 1
        raise ValueError(f"No token ends {tail!r}")

    def feed(self, word, letter: str):
        """A piece's state after one more byte, and the change in tokens."""
        tail, back = word or ("", ((None, 0),))
        tail += letter
        token, change = self.last(tail, back, "")
        back = [None if b is None else (b[0], b[1] - change) for b in back]
        cut = 0
        while tail[cut:] not in self.prefixes:
            cut += 1
        # Places from which no token can grow are forgotten, so that more prefixes share a state.
        kept = [b if b and tail[at:] in self.prefixes else None for at, b in enumerate(back[cut:], cut)]
        return (tail[cut:], (*kept, (token, 0))), change

    def close(self, word) -> int:
        """The change in tokens when the piece ends."""
        if not word or not self.suffix:
            return 0
        return self.last(*word, self.suffix)[1]

    # Between pieces.

    def add(self, word, char: str):
        change = 0
        for byte in char.encode():
            word, n = self.feed(word, self.letters[byte])
            change += n
        return word, change

    def whole(self, piece: str) -> int:
        word, change = self.add(None, piece)
        return change + self.close(word)

    def kind(self, char: str) -> str:
        """The class of a character, as the tokenizer's own pieces tell."""
        if char not in self.kinds:
            cut = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
            kind = "space" if not cut(char) else "letter" if cut("a" + char) == 1 else "other" if cut("!" + char) == 1 else "number"
            self.kinds[char] = kind
        return self.kinds[char]

    def move(self, key, char: str):
        """The key after one lower-case character, and the change in tokens."""
        mode, word = key
        kind = self.kind(char)
        if (mode == _LETTERS and kind == "letter") or (mode == _OTHER and kind == "other"):
            word, n = self.add(word, char)
            return (mode, word), n
        if mode == _QUOTE:
            if word:  # a quote and one letter so far: a pair, or else two pieces
                if char == _PAIRS[word]:
                    return (_OPEN, None), self.whole("'" + word + char) - self.whole("'" + word)
                letters, n = self.add(None, word)
                after, m = self.move((_LETTERS, letters), char)
                return after, self.whole("'") + n + m - self.whole("'" + word)
            if char in _SHORT:
                return (_OPEN, None), self.whole("'" + char) - self.whole("'")
            if char in _PAIRS:
                return (_QUOTE, char), self.whole("'" + char) - self.whole("'")
            if kind == "other":
                word, n = self.add(None, "'" + char)
                return (_OTHER, word), n - self.whole("'")
            ended = 0
        else:
            ended = self.close(word)
        if kind == "space":
            return (_OPEN, None), ended
        if kind == "number":
            return (_OPEN, None), ended + self.whole(char)
        if char == "'":
            return (_QUOTE, ""), ended + self.whole("'")
        word, n = self.add(None, char)
        return (_LETTERS if kind == "letter" else _OTHER, word), ended + n

    def end(self, state: State) -> int:
        """The change in tokens when the text ends; a quote and what follows it count as a piece until then."""
        return self.hop(state, " ")[1]

    def hop(self, state: State, char: str):
        """The transition of a state by a character, compiled if it is new."""
        found = state.get(char)
        if found is None:
            if 0xD800 <= ord(char) < 0xE000:
                found = self.start, 1 + self.end(state)
            else:
                key, change = state.key, 0
                if char not in self.lowered:
                    self.lowered[char] = self.library.normalizer.normalize_str(char)
                for c in self.lowered[char]:
                    key, n = self.move(key, c)
                    change += n
                found = self.state(key), change
            state[char] = found
            self.size += 1
        return found

    # Texts.

    def prepare(self, text: str) -> str:
        """The text in normal form, special strings as marks."""
        normal = lambda part: part if part.isascii() or unicodedata.is_normalized("NFC", part) else self.library.normalizer.normalize_str(part)
        if self.special is None or not self.special.search(text):
            return normal(text)
        return chr(_MARK).join(normal(part) for part in self.special.split(text))

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            found = state.get(char)
            if found is None:
                found = self.hop(state, char)
            state, change = found
            total += change
        return state, total

    def word(self, word: str) -> int:
        """Tokens of a run of characters between white space, after which all states are the first."""
        state, total = self.run(self.start, word)
        found = self.words[word] = total + self.end(state)
        return found

    def count(self, text: str) -> int:
        """Tokens of a prepared text. The ways of whole words through the transducer are kept, too."""
        if self.size > self.keep:
            self.clear()
        elif len(self.words) > self.keep:
            self.words = {}
        get, total = self.words.get, 0
        for word in _WORD.findall(text):
            n = get(word)
            total += self.word(word) if n is None else n
        return total

    def map(self, text: str) -> Map:
        """The map of a chunk of prepared text."""
        if self.size > self.keep:
            self.clear()
        space = _SPACE.search(text)
        if space is None:
            return Map(text, None, 0)
        state, total = self.run(self.start, text[space.start() :])
        return Map(text[: space.start()], state.key, total)

    def compose(self, left: Map, right: Map) -> Map:
        if left.last is None:
            return Map(left.head + right.head, right.last, right.count)
        state, n = self.run(self.state(left.last), right.head)
        if right.last is None:
            return Map(left.head, state.key, left.count + n)
        return Map(left.head, right.last, left.count + n + self.end(state) + right.count)

    def total(self, whole: Map) -> int:
        """Tokens of a text whose map this is."""
        state, n = self.run(self.start, whole.head)
        if whole.last is None:
            return n + self.end(state)
        return n + self.end(state) + whole.count + self.end(self.state(whole.last))


_SPACE, _WORD = re.compile(r"[ \t\n\r]"), re.compile(r"[^ \t\n\r]+")


@dataclass(frozen=True)
class Map:
    """What a chunk does to any state: characters up to the first white space, key of the last state, tokens after it.

    Without white space ``last`` is None, and the state after the chunk is that before it led through ``head``.
    """

    head: str
    last: tuple | None
    count: int

    def pack(self) -> bytes:
        return pickle.dumps((self.head.encode("utf-8", "surrogatepass"), self.last, self.count))

    @staticmethod
    def unpack(data: bytes) -> Map:
        head, last, count = pickle.loads(data)
        return Map(head.decode("utf-8", "surrogatepass"), last, count)


_COMPILED: dict[int, Transducer] = {}


def _compiled(tokenizer: str) -> Transducer:
    """The worker's transducer of this tokenizer; it is kept between tasks, at most ``KEEP`` transitions."""
    key = hash(tokenizer)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(tokenizer)
    return _COMPILED[key]


def counts(docs: DataFrame, tokenizer: str, text_col="text", chunk: int = CHUNK) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8) and ``n_tokens``; columns of these names are replaced, all others pass.

    NULL and empty texts have neither bytes nor tokens. Texts of more than ``chunk`` bytes are
    dealt to tasks chunk by chunk. Repeated rows are counted each; an empty table stays empty.
    """
    kept = docs.select([c for c in docs.columns if c not in ("n_bytes", "n_tokens")])
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    sized = kept.withColumn("n_bytes", size.cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    form = T.StructType([*sized.schema.fields, T.StructField("n_tokens", T.LongType())])
    at = sized.columns.index(text_col)

    def whole(batches):
        own = _compiled(shared.value)
        for batch in batches:
            values = [own.count(own.prepare(t)) if t else 0 for t in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    short = sized.where(size <= chunk).mapInArrow(whole, form)
    long = sized.where(size > chunk).withColumn("_row", F.monotonically_increasing_id())

    def split(batches):
        own = _compiled(shared.value)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ready = own.prepare(text.as_py())
                for k, i in enumerate(range(0, len(ready), chunk)):
                    part = ready[i : i + chunk].encode("utf-8", "surrogatepass")
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k], pa.int64()), pa.array([part], pa.binary())], names=["_row", "_k", "data"])

    def maps(batches):
        own = _compiled(shared.value)
        for batch in batches:
            made = [own.map(x.as_py().decode("utf-8", "surrogatepass")).pack() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=batch.schema.names)

    def composed(table: pa.Table) -> pa.Table:
        own = _compiled(shared.value)
        parts = sorted(zip(table.column("_k").to_pylist(), table.column("data").to_pylist(), strict=True))
        row, k = table.column("_row")[0].as_py(), parts[0][0] // FAN
        made = [Map.unpack(d) for _, d in parts]
        while len(made) > 1:
            made = [own.compose(*made[i : i + 2]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
        return pa.table({"_row": pa.array([row]), "_k": pa.array([k], pa.int64()), "data": pa.array([made[0].pack()], pa.binary())})

    part = "_row long, _k long, data binary"
    scan = long.select("_row", text_col).mapInArrow(split, part).repartition("_row", "_k").mapInArrow(maps, part)
    for _ in range(ROUNDS):
        scan = scan.groupBy("_row", F.floor(F.col("_k") / FAN)).applyInArrow(composed, part)

    def total(batches):
        own = _compiled(shared.value)
        for batch in batches:
            values = [own.total(Map.unpack(x.as_py())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["_row", "n_tokens"])

    found = scan.mapInArrow(total, "_row long, n_tokens long")
    return short.unionByName(long.join(found, "_row").select(form.names))


def query(spark, sf_dir, path: str | None = None, limit: int = 2048):
    """op11: tokens of every document, and whether they are more than ``limit``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = counts(docs, read_tokenizer(path or public_path()))
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
