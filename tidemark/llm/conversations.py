"""Conversation structure repair: each conversation is edited into ``(s?(ua)+)?`` at least cost.

Turns are aligned to strings of that grammar by Wagner-Fischer tables. A block of at most
``BLOCK`` turns is aligned to every feasible length of the alternating string, from each state
in which the turns before it can leave the grammar; cells and lengths that cannot come under
the cost found so far are left out (Ukkonen's band). Of equally cheap edits the audit that
comes first in ASCII order is kept. Inserts belong to the turn that follows them, so no audit
of a block begins another one, and the first audit of a conversation is made of first audits
of its blocks: a chain over blocks needs the cost of each (state before, state after) only.

Rows are dealt by ranges of (conversation, turn, ...) and sorted, so a conversation that holds
a third of all rows is spread over many tasks. A task repairs the conversations that lie
inside its range whole. Those that reach over its ends, or over ``BYTES``, are cut into
pieces: earlier copies of a turn are found by digest, each piece gives its costs by state, one
small group per conversation picks the states between the pieces, and the pieces are then
edited on their own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage

#: Turns that are aligned in one table, and bytes of a conversation that a task holds.
BLOCK, BYTES = 32, 1 << 24
_SPACE = "\t\n\x0b\x0c\r "
#: States of the grammar: nothing yet, after the system turn, a user turn next, an assistant turn next.
START, SYSTEM, ASK, ANSWER = range(4)
STATES = (START, SYSTEM, ASK, ANSWER)
_STEP = {(START, "s"): SYSTEM, (START, "u"): ANSWER, (SYSTEM, "u"): ANSWER, (ASK, "u"): ANSWER, (ANSWER, "a"): ASK}
#: What has to be inserted at the end of a conversation.
CLOSE = {START: "", SYSTEM: "II", ASK: "", ANSWER: "I"}
KEEP, REROLE, INSERT, DELETE = 0, 2, 2, 3
_NONE = 1 << 60


def _apart(rows: int, target: int) -> int:
    """The least that it costs to make this many turns as long as the target."""
    return DELETE * (rows - target) if rows > target else INSERT * (target - rows)


def align(codes: str, target: str, limit: int) -> tuple[int, str] | None:
    """Least cost and first audit of turning all ``codes`` into ``target``, if within ``limit``.

    A code is a turn's initial, upper case if the turn is truncated, or ``x`` if it has to go.
    The last edit is one of a turn, not an insert.
    """
    m, n = len(codes), len(target)
    upto = [0]  # turns that may stay
    for c in codes:
        upto.append(upto[-1] + (c != "x"))
    slack = limit - DELETE * (m - upto[m])
    table = [[_NONE] * (n + 2) for _ in range(m + 2)]
    table[m][n] = 0
    for i in range(m - 1, -1, -1):
        row, below, c, k = table[i], table[i + 1], codes[i], upto[i]
        low = c.lower()
        stay = _NONE if c == "x" else int(c != low)
        for j in range(min(n, k + max(slack, 0) // INSERT), -1, -1):
            if _apart(k, j) + _apart(upto[m] - k, n - j) > slack:
                continue
            best = DELETE + below[j]
            if j < n:
                t = target[j]
                if t != "s":
                    best = min(best, INSERT + row[j + 1])
                if low == t:
                    best = min(best, stay + below[j + 1])
                elif t != "s":
                    best = min(best, REROLE + stay + below[j + 1])
            row[j] = best
    if table[0][0] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < m:
        here, c = table[i][j], codes[i]
        low = c.lower()
        if here == DELETE + table[i + 1][j]:
            audit.append("D")
            i += 1
        elif j < n and target[j] != "s" and here == INSERT + table[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if low == target[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


def _target(state: int, length: int, system: bool) -> tuple[str, int]:
    """The string of this length that the grammar allows from a state on, and the state after it."""
    head = "s" if system else ""
    rest = length - len(head)
    turns = ("au" if state == ANSWER else "ua") * (rest // 2 + 1)
    after = SYSTEM if system else state
    if rest:
        after = ASK if (rest % 2 == 0) == (state != ANSWER) else ANSWER
    return head + turns[:rest], after


@lru_cache(1 << 14)
def block(codes: str, state: int) -> dict[int, tuple[int, str]]:
    """By state after them, the least cost and first audit of these turns from ``state`` on."""
    free = len(codes) - codes.count("x")
    forced = DELETE * (len(codes) - free)
    best: dict[int, tuple[int, str]] = {}
    for system in (True, False) if state == START else (False,):
        for length in sorted(range(int(system), 2 * len(codes) + free + 3), key=lambda n: _apart(free, n)):
            target, after = _target(state, length, system)
            least = forced + _apart(free, length)
            if least > (best[after][0] if after in best else _NONE):
                # Lengths come by what they cost at least; both parities are done when neither can be beaten.
                if length > system and all(q in best and least > best[q][0] for q in (ASK, ANSWER)):
                    break
                continue
            # The first table of a state is full; the cost found bounds all that follow.
            found = align(codes, target, best[after][0] if after in best else DELETE * len(codes) + INSERT * length)
            if found and (after not in best or found < best[after]):
                best[after] = found
    return best


def chain(parts: list, start: int, end: dict[int, int]) -> list[tuple[int, int]] | None:
    """The cheapest way through the parts: the state before and after each; equal costs by audit.

    ``parts`` are functions of a state, giving {state after: (cost, audit or its rank)};
    ``end`` has the cost of each state after the last one.
    """
    value = [dict(end)]
    for part in reversed(parts):
        after = value[-1]
        value.append({q: min((c + after.get(r, _NONE) for r, (c, _) in part(q).items()), default=_NONE) for q in STATES})
    value.reverse()
    if value[0][start] >= _NONE:
        return None
    way, state = [], start
    for part, here, after in zip(parts, value, value[1:], strict=False):
        ways = [(audit, r) for r, (c, audit) in part(state).items() if c + after.get(r, _NONE) == here[state]]
        nxt = min(ways)[1]
        way.append((state, nxt))
        state = nxt
    return way


def _blocks(codes: str) -> list:
    return [lambda q, c=codes[i : i + BLOCK]: block(c, q) for i in range(0, len(codes), BLOCK)]


def piece(codes: str, start: int, end: dict[int, int]) -> tuple[int, str, int] | None:
    """Cost, audit and last state of a run of turns."""
    parts = _blocks(codes)
    way = chain(parts, start, end)
    if way is None:
        return None
    used = [part(q)[r] for part, (q, r) in zip(parts, way, strict=True)]
    return sum(c for c, _ in used), "".join(a for _, a in used), way[-1][1] if way else start


_CLOSING = {q: INSERT * len(x) for q, x in CLOSE.items()}


def repair_codes(codes: str) -> tuple[int, str]:
    """Least cost and first audit of a whole conversation."""
    cost, audit, state = piece(codes, START, _CLOSING)
    return cost + _CLOSING[state], audit + CLOSE[state]


def _code(initial: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "x"
    letter = initial if initial in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


def _apply(rows: list[dict], audit: str, state: int, tile: int) -> list[dict]:
    """The edited rows of a piece: each original turn once, inserts between them."""
    out, at = [], iter(rows)
    for place, letter in enumerate(audit):
        if letter == "I":
            row = {"conv_id": rows[0]["conv_id"], "role": "assistant" if state == ANSWER else "user", "text": ""}
        else:
            row = dict(next(at))
            if letter == "R":
                row["role"] = "assistant" if state == ANSWER else "user"
        out.append({**row, "tile": tile, "place": place, "edit": letter, "digest": None})
        if letter != "D":
            state = _STEP[state, row["role"][:1]]
    return out


_FIELDS = ["tile", "place", "turn", "edit", "fault", "initial", "role", "text", "digest"]


def _schema(conv: T.DataType) -> T.StructType:
    plain = {"tile": T.LongType(), "place": T.LongType(), "turn": T.LongType(), "digest": T.BinaryType()}
    return T.StructType([T.StructField("conv_id", conv), *[T.StructField(n, plain.get(n, T.StringType())) for n in _FIELDS]])


def _arrow(conv: pa.DataType) -> pa.Schema:
    plain = {"tile": pa.int64(), "place": pa.int64(), "turn": pa.int64(), "digest": pa.binary()}
    return pa.schema([("conv_id", conv), *[(n, plain.get(n, pa.string())) for n in _FIELDS]])


def facts(rows: DataFrame) -> DataFrame:
    """Turns as the repair reads them: NULL role and text are one space; own faults, initial, digest."""
    typed = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    ends = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(ends == "", "blank").when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), "truncated")
    conv = F.col("conv_id").cast("string")
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (conv, F.col("role"), F.col("text"))]
    return typed.select(
        "*", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"), F.unhex(F.md5(F.concat(*parts).cast("binary"))).alias("digest")
    )


def _whole(batches, hold: int):
    """Edits of the conversations that lie inside this task's sorted rows; the others as pieces, unedited."""
    tiles = (TaskContext.get().partitionId() << 32 | n for n in count())
    # The first conversation of a task may have begun before it.
    state = {"rows": [], "seen": set(), "bytes": 0, "cut": True}
    kind, ready = None, []

    def raw():
        tile = next(tiles)
        made = [{**r, "tile": tile, "place": i} for i, r in enumerate(state["rows"])]
        state.update(rows=[], seen=set(), bytes=0, cut=True)
        return made

    def finish():
        if state["cut"]:
            return raw()
        held = state["rows"]
        for r in held:
            if r["fault"] != "blank" and r["digest"] in state["seen"]:
                r["fault"] = "duplicate"
            state["seen"].add(r["digest"])
        _, audit = repair_codes("".join(_code(r["initial"], r["fault"]) for r in held))
        return _apply(held, audit, START, next(tiles))

    def flush():
        nonlocal ready
        batch = pa.RecordBatch.from_pylist(ready, kind)
        ready = []
        return batch

    last, size = (), 0
    for batch in batches:
        kind = kind or _arrow(batch.schema.field("conv_id").type)
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        at = 0
        while at < batch.num_rows:  # few rows at a time, as texts may be long
            end, held = at, 0
            while end < batch.num_rows and (end == at or held + sizes[end] <= 1 << 20):
                held += sizes[end]
                end += 1
            for r, n in zip(batch.slice(at, end - at).to_pylist(), sizes[at:end], strict=True):
                if last != (r["conv_id"],):
                    if last:
                        ready += finish()
                        state.update(rows=[], seen=set(), bytes=0, cut=False)
                    last = (r["conv_id"],)
                elif state["bytes"] > hold:
                    ready += raw()
                state["rows"].append(r)
                state["bytes"] += n + 200
                size += n
                if len(ready) > 4096 or size > 1 << 21:
                    size = 0
                    yield flush()
            at = end
    if state["rows"]:
        ready += raw()
    if ready:
        yield flush()


def _transfer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A piece's least cost and the audit's rank by (state before, state after)."""
    held = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "initial", "fault")), strict=True))
    codes, conv = "".join(_code(i, f) for _, i, f in held), table.column("conv_id")
    out = []
    for q in STATES:
        found = {r: made for r in STATES if (made := piece(codes, q, {r: 0}))}
        order = sorted({audit for _, audit, _ in found.values()})
        out += [(key[0].as_py(), q, r, cost, order.index(audit)) for r, (cost, audit, _) in found.items()]
    columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
    first = conv.chunk(0)[:1] if conv.num_chunks else pa.array([None], conv.type)
    return pa.Table.from_arrays([first.take(pa.array([0] * len(out))), *columns], names=["conv_id", "tile", "before", "after", "cost", "rank"])


def _route(table: pa.Table) -> pa.Table:
    """The states between the pieces of one conversation."""
    tiles: dict[int, dict] = {}
    for r in table.to_pylist():
        tiles.setdefault(r["tile"], {}).setdefault(r["before"], {})[r["after"]] = (r["cost"], r["rank"])
    order = sorted(tiles)
    way = chain([lambda q, t=tiles[t]: t.get(q, {}) for t in order], START, _CLOSING)
    columns = [order, [q for q, _ in way], [r for _, r in way], [0] * (len(order) - 1) + [1]]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["tile", "before", "after", "last"])


def _edit(table: pa.Table, route: pa.Table) -> pa.Table:
    """The edited rows of a piece, given the states around it."""
    held = sorted(table.to_pylist(), key=lambda r: r["place"])
    tile, before, after, last = (route.column(c)[0].as_py() for c in ("tile", "before", "after", "last"))
    _, audit, _ = piece("".join(_code(r["initial"], r["fault"]) for r in held), before, {after: 0})
    return pa.Table.from_pylist(_apply(held, audit + CLOSE[after] * last, before, tile), _arrow(table.schema.field("conv_id").type))


def repair(rows: DataFrame, hold: int = BYTES) -> DataFrame:
    """Every edit of every conversation: conv_id, tile, place, turn, edit, fault, initial, role, text.

    ``rows`` has conv_id, turn, role and text; other columns are dropped. In order of tile and
    place, an edit keeps (K), reroles (R) or deletes (D) a turn or inserts (I) an empty one;
    role and text are those after the edit, initial and fault those of the turn as it was.
    Turns are taken by turn (NULL first), equal turns by role, text (64 characters of each)
    and digest. NULL roles and texts count as one space, NULL ids are one conversation; empty
    texts are blank, repeated rows duplicates; very long texts are read whole. A table without
    rows has no edits. A task holds at most ``hold`` bytes of a conversation.
    """
    spark = rows.sparkSession
    keys = ["conv_id", F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)), F.left("text", F.lit(64)), "digest"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The last key deals copies of one row to several tasks.
    dealt = facts(rows).withColumn("_copy", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *keys, "_copy").sortWithinPartitions(*keys, "_copy").drop("_copy")
    form = _schema(rows.schema["conv_id"].dataType)
    first = stage(dealt.mapInArrow(lambda batches: _whole(batches, hold), form))
    raw = first.where("edit is null")
    earliest = raw.groupBy("digest").agg(F.min(F.struct("tile", "place")).alias("_first"))
    again = (F.col("fault").isNull() | (F.col("fault") != "blank")) & (F.struct("tile", "place") != F.col("_first"))
    marked = stage(raw.join(earliest, "digest").withColumn("fault", F.when(again, "duplicate").otherwise(F.col("fault"))).select(form.names))
    kind = T.StructType([form["conv_id"], *[T.StructField(n, T.LongType()) for n in ("tile", "before", "after", "cost", "rank")]])
    costs = marked.select("conv_id", "tile", "place", "initial", "fault").groupBy("tile").applyInArrow(_transfer, kind)
    routes = costs.groupBy("conv_id").applyInArrow(_route, "tile long, before long, after long, last long")
    cut = marked.groupBy("tile").cogroup(routes.groupBy("tile")).applyInArrow(_edit, form)
    return first.where("edit is not null").unionByName(cut).drop("digest")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COSTS = {"K": KEEP, "R": REROLE, "I": INSERT, "D": DELETE}
_PAIRS = {"su", "ua", "au"}


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit, digest of the repaired turns.

    A digest is a chain, so a conversation passes through one task; rows stream by, and only
    the audit grows with them.
    """
    sent = edits.select("conv_id", "tile", "place", "turn", "edit", "fault", "initial", "role", "text")
    dealt = sent.repartition("conv_id").sortWithinPartitions("conv_id", "tile", "place")

    def run(batches):
        now, kind, done = None, None, []

        def close():
            turns = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            values = {c: now[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")}
            done.append({**values, "gaps": turns, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()})

        def flush():
            nonlocal done
            out, done = pa.RecordBatch.from_pylist(done, kind), []
            return out

        for batch in batches:
            if kind is None:
                counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
                conv = batch.schema.field("conv_id")
                kind = pa.schema([conv, *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            columns = [batch.column(c) for c in ("conv_id", "turn", "edit", "fault", "initial", "role", "text")]
            for i in range(batch.num_rows):
                conv, turn, edit, fault, initial, role, text = (c[i].as_py() for c in columns)
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        close()
                    now = dict(conv_id=conv, turns=0, low=None, high=None, before=None, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit=[], any=False)
                    now["hash"] = hashlib.sha256()
                now["audit"].append(edit)
                now["cost"] += _COSTS[edit] + (fault == "truncated" and edit != "D")
                if edit != "D":
                    now["hash"].update((f"\n{role}:{text}" if now["any"] else f"{role}:{text}").encode())
                    now["any"] = True
                if edit != "I":
                    if fault:
                        now[fault] += 1
                    if now["before"] is not None and now["before"] + initial not in _PAIRS:
                        now["illegal"] += 1
                    now["before"] = initial
                    if turn is not None and turn != now["high"]:
                        now["turns"] += 1
                        now["low"] = turn if now["low"] is None else now["low"]
                        now["high"] = turn
                if len(done) >= 4096:
                    yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    return dealt.mapInArrow(run, T.StructType([edits.schema["conv_id"], *T._parse_datatype_string(REPORT).fields]))


def damage(rows: DataFrame) -> DataFrame:
    """The rows of the query: by crc32 of ``conv_id:turn`` some are dropped, emptied, cut, repeated or given to the user."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(text["role"]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"]).alias("text"),
        kind.alias("_kind"),
    ).where("_kind <> 0")
    return hurt.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def query(spark, sf_dir):
    """op13: the audited repair of every conversation after damage; those without rows left have zeros."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = report(repair(damage(rows)))
    every = rows.select("conv_id").distinct()
    joined = every.alias("e").join(made.alias("m"), F.col("e.conv_id").eqNullSafe(F.col("m.conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "e.conv_id",
        *[F.coalesce(F.col(f"m.{c}"), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("m.audit", F.lit("")).alias("audit"),
        F.coalesce("m.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """The repair as a fold over a conversation's turns: per state the least ``cost then audit`` as text."""

    def add(state, cost, letters):
        return f"printf('%09d', CAST(left({state}, 9) AS INT) + {cost}) || substr({state}, 10) || {letters}"

    far, start = "'900000000'", "'000000000'"
    # Inserts before a turn: one leads to the other state of the pair, two lead on from the system turn.
    insert = f"""[acc[1], acc[2], least(acc[3], {add("acc[4]", 2, "'I'")}, {add("acc[2]", 4, "'II'")}),
                  least(acc[4], {add("acc[3]", 2, "'I'")}, {add("acc[1]", 2, "'I'")}, {add("acc[2]", 2, "'I'")})]"""
    out = lambda i: add(f"acc[{i}]", 3, "'D'")
    move = lambda i, c: (
        f"CASE WHEN x[2] = 'x' THEN {far} WHEN x[1] = '{c}' THEN {add(f'acc[{i}]', 'CAST(x[3] AS INT)', chr(39) + 'K' + chr(39))} "
        + (f"ELSE {far} END" if c == "s" else f"ELSE {add(f'acc[{i}]', '2 + CAST(x[3] AS INT)', chr(39) + 'R' + chr(39))} END")
    )
    turn = f"""[{out(1)}, least({out(2)}, {move(1, "s")}), least({out(3)}, {move(4, "a")}),
                least({out(4)}, {move(1, "u")}, {move(2, "u")}, {move(3, "u")})]"""
    last = f"""least(e[1], e[3], {add("e[2]", 4, "'II'")}, {add("e[4]", 2, "'I'")})"""
    space = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    crc = """xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
               lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END, 4294967295), 4294967295)"""
    return rf"""
WITH kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM hurt),
ends AS (SELECT *, left(role, 1) AS initial, rtrim(text, {space}) AS body,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM placed),
judged AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM ends),
folded AS (SELECT conv_id,
           CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
           list_reduce(flatten(list([[''], [initial, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE '' END,
             CASE WHEN fault = 'truncated' THEN '1' ELSE '0' END]] ORDER BY n)),
             lambda acc, x: CASE WHEN len(x) = 1 THEN {insert} ELSE {turn} END, [{start}, {far}, {far}, {far}]) AS e
         FROM judged GROUP BY conv_id),
best AS (SELECT *, {last} AS found FROM folded),
letters AS (SELECT conv_id, letter, p, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER w AS n,
           sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER w AS at, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS size
         FROM (SELECT conv_id, unnest(string_split(substr(found, 10), '')) AS letter, generate_subscripts(string_split(substr(found, 10), ''), 1) AS p FROM best)
         WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
said AS (SELECT l.conv_id, sha256(string_agg(CASE l.letter WHEN 'K' THEN j.role ELSE CASE WHEN (l.at + l.size) % 2 = 1 THEN 'user' ELSE 'assistant' END END
             || ':' || CASE l.letter WHEN 'I' THEN '' ELSE j.text END, chr(10) ORDER BY l.p)) AS repaired_sha256
         FROM letters l LEFT JOIN judged j ON l.conv_id IS NOT DISTINCT FROM j.conv_id AND l.n = j.n AND l.letter <> 'I' WHERE l.letter <> 'D' GROUP BY l.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(found, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(found, 10), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN said s ON a.conv_id IS NOT DISTINCT FROM s.conv_id"""


ORACLE = _oracle()
