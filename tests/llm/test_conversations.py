import itertools
import random

import pytest
from oracle_check import compare, duck

from tidemark.llm import conversations as C

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(codes):
    """All edits with up to two inserts before a turn, kept in full: least cost, then first audit."""
    kept = {C.START: {(0, "")}}
    for code in codes:
        for q, letters in ((q, n) for n in range(2) for q in list(kept)):
            for ch in "ua":
                if (q, ch) in C._STEP:
                    more = {(c + 2, a + "I") for c, a in kept[q] if not a.endswith("II")}
                    kept.setdefault(C._STEP[q, ch], set()).update(more)
        after = {q: {(c + 3, a + "D") for c, a in found} for q, found in kept.items()}
        low = code.lower()
        for q, ch in C._STEP:
            if code == "x" or q not in kept or (ch == "s" and low != "s"):
                continue
            cost, letter = (0, "K") if low == ch else (2, "R")
            after.setdefault(C._STEP[q, ch], set()).update({(c + cost + (code != low), a + letter) for c, a in kept[q]})
        kept = after
    return min((c + 2 * len(C.CLOSE[q]), a + C.CLOSE[q]) for q, found in kept.items() for c, a in found)


def test_least_cost_and_first_audit():
    for size in range(4):
        for codes in itertools.product("suaoxSUA", repeat=size):
            assert C.repair_codes("".join(codes)) == brute("".join(codes)), codes
    rng = random.Random(3)
    for _ in range(60):
        codes = "".join(rng.choices("suaoxUA", k=rng.randint(4, 6)))
        assert C.repair_codes(codes) == brute(codes), codes


def test_blocks_do_not_matter(monkeypatch):
    rng = random.Random(4)
    for _ in range(40):
        codes = "".join(rng.choices("suauauxUAo", k=rng.randint(20, 60)))
        made = []
        for size in (5, 32, 64):
            monkeypatch.setattr(C, "BLOCK", size)
            made.append(C.repair_codes(codes))
        assert made[0] == made[1] == made[2]


def odd_rows():
    rng = random.Random(5)
    rows = [(i % 7, rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "no", " \n", None, "", "Is it? "])) for i in range(600)]
    rows += [(None, 0, "user", "Lost."), (None, None, None, None), (50, None, None, ""), (51, 0, "user", "long! " * 40_000)]
    return rows * 2


def whole(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("limit", [1 << 24, 600])
def test_cut_conversations_are_repaired_alike(spark, limit):
    """Long conversations over many tasks and pieces give what one table per conversation gives."""
    frame = spark.createDataFrame([(*r, "x", "y") for r in odd_rows()], SCHEMA + ", tile string, edit string").repartition(5)
    edits = C.repair(frame, limit).collect()
    by_conv = {}
    for r in sorted(edits, key=lambda r: (r["tile"], r["place"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    assert len(by_conv) == 10
    for conv, made in by_conv.items():
        turns = [r for r in made if r["edit"] != "I"]
        assert len(turns) == sum(r[0] == conv for r in odd_rows())
        key = [(r["turn"] is not None, r["turn"] or 0) for r in turns]
        assert key == sorted(key)
        audit = "".join(r["edit"] for r in made)
        _, expected = C.repair_codes("".join(C._code(r["initial"], r["fault"]) for r in turns))
        assert audit == expected
        roles = "".join(r["role"][0] for r in made if r["edit"] != "D")
        assert roles in ("", "s" * (len(roles) % 2) + "ua" * (len(roles) // 2)) and len(roles) != 1
    repeated = sum(r["fault"] == "duplicate" for r in edits)
    seen = {(r[0], r[2] or (" " if r[2] is None else ""), r[3]) for r in odd_rows() if (r[3] or "").strip()}
    assert repeated == sum(bool((r[3] or "").strip()) for r in odd_rows()) - len(seen)


def test_odd_rows_against_sql(spark, tmp_path):
    spark.createDataFrame([r for r in odd_rows()[:300]], SCHEMA).dropDuplicates(["conv_id", "turn"]).write.parquet(str(tmp_path / "conversations.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(C.query(spark, str(tmp_path)), con, C.ORACLE) is None


def test_query(spark):
    assert compare(C.query(spark, SF), duck(SF), C.ORACLE) is None


def test_empty_table(spark):
    assert C.report(C.repair(spark.createDataFrame([], SCHEMA))).count() == 0
