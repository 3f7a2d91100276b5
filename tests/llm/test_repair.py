"""Conversation repair: the search against exhaustive relaxation, long conversations in blocks against whole ones, edge rows."""

import hashlib
import random
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import repair as rp

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(kinds, entry, goal=None):
    """The best (cost, audit) for every place and state, improved until nothing changes."""
    best, changed = {(0, entry): (0, "")}, True
    while changed:
        changed = False
        for (i, s), (c, a) in list(best.items()):
            if i == len(kinds):
                continue
            for at, found in [((i, rp.allowed(s)[-1][1]), (c + 3, a + "I")), *(((i + 1, t), (c + k, a + x)) for x, k, t in rp.edits(kinds[i], s))]:
                if at not in best or found < best[at]:
                    best[at], changed = found, True
    ends = {s: best[len(kinds), s] for s in range(4) if (len(kinds), s) in best}
    return ends.get(goal) if goal is not None else min((c + 3 * len(rp.CLOSING[s]), a + rp.CLOSING[s]) for s, (c, a) in ends.items())


def test_search_is_optimal():
    draw = random.Random(11)
    for n in range(7):
        for _ in range(60):
            kinds = "".join(draw.choice("suaoSUAOxua") for _ in range(n))
            assert rp.search(kinds) == exhaustive(kinds, rp.START)
            for entry in range(4):
                assert [rp.search(kinds, entry, goal) for goal in range(4)] == [exhaustive(kinds, entry, goal) for goal in range(4)]
            cut = draw.randrange(n + 1)
            way = rp.chain(map(rp.ways_through, (kinds[:cut], kinds[cut:])))
            assert "".join(a for _, a in way) == rp.search(kinds)[1] and rp.cost_of(rp.search(kinds)[1], kinds) == rp.search(kinds)[0]


def test_literal_conversations():
    assert rp.search("") == (0, "") and rp.search("s") == (4, "D") and rp.search("u") == (3, "KI") and rp.search("a") == (3, "IK")
    assert rp.search("sua") == (0, "KKK") and rp.search("uu") == (3, "KR") and rp.search("uua") == (3, "KIKK")
    assert rp.search("xua") == (4, "DKK") and rp.search("uA") == (3, "KK")


@pytest.fixture(scope="module")
def turns(spark):
    draw, rows = random.Random(7), []
    for conv, n in ((None, 9), (1, 40), (2, 1), (3, 0), (4, 700), (5, 6)):
        for k in range(n):
            text = draw.choice(["Well said.", "Is it?", "cut sho", " ", "", "Yes!", f"number {k}.", None, "x" * draw.randrange(400)])
            rows.append((conv, draw.choice([None, k, k, k + 3]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
        rows += [(conv, 2, "user", "Twice.")] * 3 if n > 5 else []
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def report(df):
    return {r.conv_id: tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}


def test_blocks_equal_groups(spark, turns):
    """The distributed way for every conversation of more than 5 rows gives what one group gives, texts in order included."""
    whole, whole_turns = rp.repair(turns)
    parted, parted_turns = rp.repair(turns, group_rows=5)
    assert report(whole) == report(parted) and set(report(whole)) == {None, 1, 2, 4, 5}
    for rows in (whole_turns, parted_turns):
        lines = {}
        for r in rows.orderBy("conv_id", "at").collect():
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        for r in whole.collect():
            assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_damaged_rows_equal_sql(spark, turns, tmp_path):
    """Nulls, repeated and tied rows against SQL, other columns in the table; conversations of which all rows are dropped."""
    gone = [k for k in range(1000, 3000) if crc32(f"{k}:0".encode()) % 20 == 0][:3]
    rows = turns.unionByName(spark.createDataFrame([(k, 0, "user", "Hello.") for k in gone], SCHEMA)).withColumns({"dropped": F.lit(True), "key": F.lit("k"), "repaired": F.lit(1)})
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    found = rp.op11_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = sorted(found.columns)
    wanted = {r[names.index("conv_id")]: r for r in con.sql(f"select {', '.join(names)} from ({rp.ORACLE_SQL})").fetchall()}
    assert report(found) == wanted
    empty = hashlib.sha256(b"").hexdigest()
    assert all(wanted[k][names.index("audit")] == "" and wanted[k][names.index("repaired_sha256")] == empty for k in gone)


def test_empty_table(spark):
    assert rp.repair(rp.damaged(spark.createDataFrame([], SCHEMA)))[0].collect() == []
