import hashlib
import math
import random
import re

from tidemark.llm import secrets

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def p_value(token):
    body = token.rstrip("=")
    letters = next(x for pattern, x in secrets._ALPHABETS if re.search(pattern, body))
    n, k = len(body), len(letters)
    tail = lambda z: 1 / (1 + math.exp(min(700.0, 0.07056 * z**3 + 1.5976 * z)))
    two = lambda z: 2 * tail(min(z, 30.0))

    def cell(c):
        if c in "0123456789+/-_":
            return 0
        if k >= 62 and c.isupper():
            return 3
        return 1 if c.lower() in "aeinorst" and k > 16 else 2

    part = [sum(cell(c) == i for c in letters) / k for i in range(4)]
    seen = [sum(cell(c) == i for c in body) for i in range(4)]
    df = sum(x > 0 for x in part) - 1
    squares = sum((o - n * x) ** 2 / (n * x) for o, x in zip(seen, part, strict=True) if x)
    chi = ((squares / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    equal, cube = sum(x**2 for x in part), sum(x**3 for x in part)
    same = sum(cell(x) == cell(y) for x, y in zip(body, body[1:], strict=False))
    runs = abs(same - (n - 1) * equal) / math.sqrt((n - 1) * equal * (1 - equal) + 2 * (n - 2) * (cube - equal**2))
    d = [letters.find(c) - (k - 1) / 2 for c in body]
    serial = abs(sum(x * y for x, y in zip(d, d[1:], strict=False)) / max(sum(x * x for x in d), 1e-9)) * math.sqrt(n)
    return min(1.0, 3 * min(tail(min(chi, 30.0)), two(runs), two(serial)))


def step(token):
    return min(240, int(-math.log10(max(p_value(token), 1e-300)) * 20))


def decoy(token, place, words):
    n, first = len(token), place * 5 % max(1, len(words))
    some = words[first : first + n // 3 + 1]
    text = "".join(w[0].upper() + w[1:] for w in some) if place % 3 == 0 else "_/"[place % 3 - 1].join(some).lower()
    return text[: n - 2] + f"{n * 37 % 100:02}" if len(text) >= n - 2 else None


def brute(texts, rate=secrets.RATE):
    tokens, steps = [], {}
    for t in texts:
        known = base(t)
        free = [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.TOKEN, t or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(m[0].rstrip("=")) >= 16]
        free = [x for x in free if not any(b[0] < x[1] and x[0] < b[3] for b in known)]
        words = re.findall(secrets.WORD, t or "")
        tokens.append([(s, e, int(math.log2(e - s)), step(x)) for s, e, x in free])
        for i, (s, e, x) in enumerate(free):
            mine = steps.setdefault(int(math.log2(e - s)), ([], []))
            mine[0].append(step(x))
            if made := decoy(x, i, words):
                mine[1].append(step(made))
    limit = {}
    for size, (real, made) in steps.items():
        for at in set(real + made):
            reported, wrong = sum(x <= at for x in real), sum(x <= at for x in made)
            if 10 ** (-at / 20) >= 0.01 and wrong * len(real) <= rate * reported * len(made):
                limit[size] = max(at, limit.get(size, -1))
    out = []
    for t, ts in zip(texts, tokens, strict=True):
        known = base(t)
        out.append((known, sorted(known + [(s, 3, "random", e) for s, e, size, at in ts if at <= limit.get(size, -1)])))
    return out


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def made_up():
    rng = random.Random(1)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda letters, n: "".join(rng.choices(letters, k=n))
    texts = [None, "", " ", "password: token: ABCDEFGHIJKLMNOP", "TOKEN='x1y2z3a4b5c6d7' Api_Key = \"short\"", "paſſword=abcdefghijklmnop toKen=abcdefghijklmnop", "é👍 secret=ABCDEFGHIJKL.mnop x", "AKIA" + "A1" * 7 + " AKIAAKIA1 xAKIA" + "Z" * 20]
    for n in (20, 24, 40, 64, 300):
        texts += [f"see {key(b64, n)} and {key('0123456789abcdef', n)} or {key('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n)}=== end" for _ in range(6)]
        texts += [f"/usr/lib/{'component' * (n // 8)}12/x aaaaaaaaaaaa{'a1' * n}"]
    texts += ["word " * 20_000 + "deadbeefdeadbeef00 " * 300]
    return texts


def test_equals_brute_force(spark):
    texts = made_up()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    made = {r["doc_id"]: r for r in secrets.scan(frame).collect()}
    expected = brute(texts)
    assert any(kind == "random" for _, spans in expected for _, _, kind, _ in spans)
    for i, (known, spans) in enumerate(expected):
        assert [tuple(x) for x in made[i]["base"]] == known, texts[i]
        assert [tuple(x) for x in made[i]["found"]] == spans, texts[i]


def identifiers(rng):
    names = "login server channel public handler socket config service order account payment value user session cache worker table index remote client update status history network".split()
    some = lambda n: [rng.choice(names) for _ in range(n)]
    while True:
        form, n = rng.randrange(3), rng.randint(3, 5)
        text = ["".join(x.title() for x in some(n)), "_".join(some(n)), "/".join(some(n)) + "/"][form] + str(rng.randrange(1, 10 ** rng.randint(1, 4)))
        if len(text) >= 20:
            yield text


def test_ordinary_identifiers_are_no_secrets_and_keys_are(spark):
    rng = random.Random(7)
    prose = "the first value of each order is kept with the account and then written to a table that other people read when they look for what has changed since last week".split()
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    ordinary = identifiers(rng)
    texts, keys = [], set()
    for i in range(6000):
        if i % 3:
            token = next(ordinary)
        else:
            token = "".join(rng.choices(b64[: rng.choice([62, 64])], k=rng.randint(20, 60)))
            if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
                continue
            keys.add(token)
        texts.append(" ".join([*rng.choices(prose, k=30), token, *rng.choices(prose, k=5)]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [texts[r["doc_id"]][x["start"] : x["end"]] for r in secrets.scan(frame).collect() for x in r["found"] if x["kind"] == "random"]
    long_keys = [k for k in keys if len(k) >= 24]
    assert sum(x not in keys for x in found) <= 0.02 * len(found)
    assert sum(k in set(found) for k in long_keys) >= 0.9 * len(long_keys)


def test_no_secrets_in_text_without_keys(spark):
    ordinary = identifiers(random.Random(3))
    texts = [(i, f"plain words stand before every name that follows here {next(ordinary)} and after it") for i in range(1000)]
    found = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sum(len(r["found"]) for r in found) <= 10


def test_p_values_of_random_tokens_reject_about_as_often_as_they_say():
    rng = random.Random(11)
    for _, letters in secrets._ALPHABETS:
        for n in (20, 32, 64, 200):
            # The alphabet is given, so that a token cannot be taken for one of a smaller alphabet.
            tokens = ["".join(rng.choices(letters, k=n)) for _ in range(1500)]
            tokens = [t for t in tokens if next(x for p, x in secrets._ALPHABETS if re.search(p, t)) == letters]
            assert sum(p_value(t) < 0.01 for t in tokens) <= 0.035 * max(len(tokens), 100)


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "é token=abcdefabcdef0123456789 b"), (2, None), (3, "clean")], "doc_id long, text string")
    made = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(frame)).collect()}
    assert made == {1: "é [secret] b", 2: None, 3: "clean"}


def test_query_on_every_document(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip((r["doc_id"] for r in rows), brute([r["text"] for r in rows]), strict=True))
    made = secrets.query(spark, SF).collect()
    assert len(made) == len(rows)
    for r in made:
        known, spans = expected[r["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == k for x in known) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(joined(known).encode()).hexdigest() and r["spans"] == joined(spans)


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
