"""Secret scans: known shapes, and tokens that pass a battery of randomness tests.

All in DataFrame functions. A token is a long run of encoding characters with letters and
digits. Its alphabet is inferred (hex, base32, base36, base62, base64, its URL form), each
alphabet is cut into two to four cells so that also 20 characters fill them, and three tests
ask whether the token looks uniformly random over that alphabet:

- chi-squared of the counts per cell (normal by the cube-root transform),
- number of runs of one cell, against its mean and variance for random symbols,
- serial correlation of neighbouring symbols.

The smallest of three p-values, times three, is the token's. A secret is a discovery against
ordinary text: of tokens that ordinary words make, at most a share ``RATE`` of what is
reported. What ordinary text makes is taken from the same corpus. Each token gets a decoy of
its own length from words of its document, joined as identifiers and paths are and ended by
two digits. In each class of lengths (a power of two each) the cutoff on p is the lowest one
at which decoys, scaled to the number of tokens, make up at most ``RATE`` of the tokens above
it; and it is never below ``LEAST``, so that tokens rejected as random are not reported where
decoys are few. The rule works on a histogram of p-values with ``STEPS`` steps to a factor of
ten, which has a bounded size however many tokens there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, LEAST, STEPS, FLOOR = 0.01, 0.01, 20, 12
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are long enough are the long ones among all runs, so the length is in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: Words that are no part of a token, from which decoys are made.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{2,}(?![A-Za-z0-9+/_=-])"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters that make up about two thirds of most Western European prose.
_COMMON = "aeinorst"
#: How to tell an alphabet, its symbols in order.
_ALPHABETS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS),
    (r"^[A-Z0-9]+$", _UPPER + _DIGITS),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"-|_", _UPPER + _LOWER + _DIGITS + "-_"),
    (r"", _UPPER + _LOWER + _DIGITS + "+/"),
)
_FOUND = "array<struct<start:int,end:int,text:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and text of all matches, leftmost first."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def add(acc, x):
        first = acc["at"] + F.length(x["gap"])
        last = first + F.length(x["hit"])
        one = F.struct(first.alias("start"), last.alias("end"), x["hit"].alias("text"))
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(both, start, add, lambda acc: acc["out"])).otherwise(F.array().cast(_FOUND))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by its logistic approximation."""
    return 1 / (1 + F.exp(F.lit(0.07056) * z * z * z + F.lit(1.5976) * z))


def cells(letters: str) -> str:
    """The cell of each symbol: 0 digits and marks, 1 common letters, 2 other letters, 3 capitals of a mixed alphabet."""
    mixed = "a" in letters and "G" in letters

    def cell(c):
        if not c.isalpha():
            return "0"
        if mixed and c.isupper():
            return "3"
        return "1" if c.lower() in _COMMON and len(letters) > 16 else "2"

    return "".join(map(cell, letters))


def shares(letters: str) -> list[float]:
    """The share of each cell among the symbols."""
    return [cells(letters).count(c) / len(letters) for c in "0123"]


def _facts(letters: str) -> Column:
    part = shares(letters)
    two, three = sum(x**2 for x in part), sum(x**3 for x in part)
    return F.struct(
        F.lit(letters).alias("letters"),
        F.lit(cells(letters)).alias("cells"),
        F.array(*[F.lit(x) for x in part]).alias("part"),
        F.lit(float(sum(x > 0 for x in part) - 1)).alias("df"),
        F.lit(two).alias("two"),
        F.lit(three).alias("three"),
    )


def p_value(token: Column) -> Column:
    """Three times the smallest p-value of the tests, at most 1; the token must not be empty."""
    body = F.rtrim(token, F.lit("="))
    alphabet = F.when(body.rlike(_ALPHABETS[0][0]), _facts(_ALPHABETS[0][1]))
    for pattern, letters in _ALPHABETS[1:-1]:
        alphabet = alphabet.when(body.rlike(pattern), _facts(letters))
    alphabet = alphabet.otherwise(_facts(_ALPHABETS[-1][1]))

    def tests(x):
        letters, n, k = x["a"]["letters"], F.length(x["body"]).cast("double"), F.length(x["a"]["letters"]).cast("double")
        places = F.transform(F.filter(F.split(x["body"], ""), lambda c: c != ""), lambda c: F.instr(letters, c))
        counts = F.array(*[F.lit(0.0)] * 4)
        zero = F.struct(counts.alias("counts"), *(F.lit(0.0).alias(name) for name in ("same", "square", "serial")), F.lit(0).alias("last"), F.lit("").alias("cell"))

        def step(acc, place):
            cell = F.substring(x["a"]["cells"], place, F.lit(1))
            d, e = place - (k + 1) / 2, acc["last"] - (k + 1) / 2
            return F.struct(
                F.transform(acc["counts"], lambda v, i: v + (i.cast("string") == cell).cast("double")).alias("counts"),
                (acc["same"] + (cell == acc["cell"]).cast("double")).alias("same"),
                (acc["square"] + d * d).alias("square"),
                (acc["serial"] + F.when(acc["last"] == 0, 0.0).otherwise(d * e)).alias("serial"),
                place.alias("last"),
                cell.alias("cell"),
            )

        def finish(acc):
            df, two, three = x["a"]["df"], x["a"]["two"], x["a"]["three"]
            both = F.arrays_zip(acc["counts"].alias("seen"), x["a"]["part"].alias("part"))
            squares = F.aggregate(both, F.lit(0.0), lambda s, c: s + F.when(c["part"] > 0, F.pow(c["seen"] - n * c["part"], F.lit(2)) / (n * c["part"])).otherwise(0.0))
            chi = (F.pow(squares / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            spread = (n - 1) * two * (1 - two) + 2 * (n - 2) * (three - two * two)
            runs = F.abs(acc["same"] - (n - 1) * two) / F.sqrt(spread)
            serial = F.abs(acc["serial"] / F.greatest(acc["square"], F.lit(1e-9))) * F.sqrt(n)
            both_tails = lambda z: 2 * _tail(F.least(z, F.lit(30.0)))
            return F.least(F.lit(1.0), 3 * F.least(_tail(F.least(chi, F.lit(30.0))), both_tails(runs), both_tails(serial)))

        return F.aggregate(places, zero, step, finish)

    return F.element_at(F.transform(F.array(F.struct(body.alias("body"), alphabet.alias("a"))), tests), 1)


def _step(p: Column) -> Column:
    """Number of the histogram step: 0 for p = 1, ``FLOOR * STEPS`` for the smallest."""
    return F.least(F.lit(FLOOR * STEPS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS)).cast("int")


def _base(text: Column) -> Column:
    """Spans of known shape (start, rank, kind, end), in order."""
    value = lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 12
    return F.array_sort(
        F.concat(
            F.transform(F.filter(_matches(text, ASSIGN), value), _span("assign", 0)),
            F.transform(_matches(text, ACCESS), _span("access", 1)),
            F.transform(_matches(text, HEX), _span("hex", 2)),
        )
    )


def _span(kind: str, rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _tokens(text: Column) -> Column:
    """Tokens with a letter and a digit: start, end and text."""
    return F.filter(_matches(text, TOKEN), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]") & (F.length(F.rtrim(x["text"], F.lit("="))) >= 16))


def _size(token: Column) -> Column:
    return F.floor(F.log2(F.length(token).cast("double"))).cast("int")


def _free(tokens: Column, base: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def decoy(token: Column, place: Column, words: Column) -> Column:
    """As many characters as the token has, made of words from number ``5 * place`` on; NULL if there are too few.

    By turns, words are joined capitalized, by underscores and by slashes; two digits of the length end them.
    """
    n = F.length(token)
    first = 1 + F.pmod(place * 5, F.greatest(F.size(words), F.lit(1)))
    # A word has three letters at least.
    some = F.slice(words, first, F.floor(n / 3).cast("int") + 1)
    form = F.pmod(place, F.lit(3))
    camel = F.array_join(F.transform(some, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    joined = F.when(form == 0, camel).when(form == 1, F.lower(F.array_join(some, "_"))).otherwise(F.lower(F.array_join(some, "/")))
    made = F.concat(F.substring(joined, F.lit(1), n - 2), F.lpad(F.pmod(n * 37, F.lit(100)).cast("string"), 2, "0"))
    return F.when(F.length(joined) >= n - 2, made)


def thresholds(docs: DataFrame, rate: float = RATE, text_col="text") -> dict[int, int]:
    """For each class of lengths the last histogram step whose tokens are reported."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(text.alias("text")).select("text", _tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    free = found.select(_free(F.col("tokens"), _base(F.col("text"))).alias("tokens"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    pairs = F.transform("tokens", lambda t, i: F.struct(t["text"].alias("text"), decoy(t["text"], i, F.col("words")).alias("decoy")))
    rated = lambda t: F.struct(
        _size(t["text"]).alias("size"), _step(p_value(t["text"])).alias("step"), F.when(t["decoy"].isNotNull(), _step(p_value(t["decoy"]))).alias("decoy")
    )
    rivals = free.select(pairs.alias("pairs")).select(F.explode(F.transform("pairs", rated)).alias("t")).select("t.*")
    seen: dict[int, dict[int, list[int]]] = {}
    # At most 31 classes of (FLOOR * STEPS + 1) steps, for tokens and for decoys.
    for row in rivals.unpivot("size", ["step", "decoy"], "side", "at").where("at is not null").groupBy("size", "side", "at").count().collect():
        seen.setdefault(row["size"], {}).setdefault(row["at"], [0, 0])[row["side"] == "decoy"] += row["count"]
    return {size: at for size, steps in seen.items() if (at := cutoff(steps, rate)) is not None}


def cutoff(steps: dict[int, list[int]], rate: float) -> int | None:
    """The last step not below ``LEAST`` up to which scaled decoys are a share of at most ``rate`` of tokens."""
    tokens, decoys = (sum(v[i] for v in steps.values()) for i in (0, 1))
    above, last = [0, 0], None
    for at in sorted(steps):
        if 10 ** (-at / STEPS) < LEAST:
            break
        above = [above[0] + steps[at][0], above[1] + steps[at][1]]
        if above[1] * tokens <= rate * above[0] * decoys:
            last = at
    return last


def scan(docs: DataFrame, rate: float = RATE, text_col="text") -> DataFrame:
    """Adds ``base`` and ``found``: spans (start, rank, kind, end), those of known shape and all.

    Kinds are assign, access, hex and random; a random token that touches a span of known
    shape is not added. A NULL text is empty and has no spans. Columns with these names are
    replaced, and repeated rows are scanned alike.
    """
    limit = thresholds(docs, rate, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = F.create_map(*(F.lit(x) for pair in limit.items() for x in pair)) if limit else F.create_map().cast("map<int,int>")
    kept = docs.select([c for c in docs.columns if c not in ("base", "found")])
    based = kept.withColumn("base", _base(text)).withColumn("found", _free(_tokens(text), F.col("base")))
    random = F.filter("found", lambda t: _step(p_value(t["text"])) <= F.coalesce(least[_size(t["text"])], F.lit(-1)))
    return based.withColumn("found", F.array_sort(F.concat("base", F.transform(random, _span("random", 3)))))


def redact(scanned: DataFrame, mark: str = "[secret]", text_col="text") -> DataFrame:
    """Replaces every span of ``found`` in the text by ``mark``; spans that overlap by one."""
    text = F.col(text_col)

    def step(acc, x):
        new = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(x["end"], acc["at"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size("found") > 0, made).otherwise(text))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir):
    """op6: secrets in every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
