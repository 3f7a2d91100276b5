"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user-assistant pairs.

Keep costs 0, Rerole (to user or assistant) 3, Delete 4 (the only edit of blank and duplicate turns), Insert of an empty user
or assistant turn 3; a truncated turn that stays adds 3. Of the cheapest repairs, the one whose audit (the edits' initials in
order) is least in ASCII is taken. It is found by depth-first branch-and-bound: an explicit stack of prefixes, lower bounds
of each suffix from each role state, an incumbent (cost, audit), and for every place and role state a table of the
best prefix, which eliminates worse ones. The search ends when the stack is empty, so its answer is proved optimal.

Turns stand in the order of turn (nulls first), role and text; nulls in role and text are one space. A null conv_id is one
conversation. Repeated rows are repeated turns, so all but the first are duplicates. A conversation whose rows are all
dropped has zeros, an empty audit and the hash of no text; an empty table gives none. Only the columns named are read.

A conversation of up to GROUP_ROWS rows and GROUP_BYTES of text is repaired by one task from one group. A longer one is cut
into blocks of at most BLOCK turns: each block is searched from every role state, the blocks' answers are chained, and the
texts stay in rows, which are hashed as a sorted stream; no task holds them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_broadcast, cut, ship
from .sql import crc32

GROUP_ROWS, GROUP_BYTES, BLOCK = 1024, 4 << 20, 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Role states: nothing yet, after system, after user, after assistant. Only the first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Edits that end a conversation from each state.
CLOSING = ("", "II", "I", "")
#: A turn's kind: the initial of its role, with a capital where it is truncated; x must be deleted, o and O are other roles.
KINDS = "suaoSUAOx"
#: (cost, audit) for each state at the end.
Ends = dict[int, tuple[int, str]]


def allowed(state: int) -> tuple[tuple[str, int], ...]:
    """The initials that may follow a state, and the states they lead to; an inserted or reroled turn is the last of them."""
    if state == USER:
        return (("a", ASSISTANT),)
    return (("s", SYSTEM), ("u", USER)) if state == START else (("u", USER),)


@cache
def edits(kind: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits of one turn, in ASCII order."""
    if kind == "x":
        return (("D", DELETE, state),)
    more = TRUNCATED if kind.isupper() else 0
    after = dict(allowed(state))
    kept = (("K", KEEP + more, after[kind.lower()]),) if kind.lower() in after else ()
    return (("D", DELETE, state), *kept, ("R", REROLE + more, allowed(state)[-1][1]))


def bounds(kinds: str, goal: int | None = None) -> list[list[int]]:
    """For each place and state, a lower bound of what the turns from there on cost: their least cost where ties of the audit
    don't matter. goal: the state at the end; None: any, and the edits that close the conversation."""
    low = [[INSERT * len(CLOSING[s]) if goal is None else 0 if s == goal else NEVER for s in range(4)]]
    for kind in reversed(kinds):
        after = low[-1]
        now = [min(c + after[t] for _, c, t in edits(kind, s)) for s in range(4)]
        for s in (USER, ASSISTANT, USER, START, SYSTEM):
            now[s] = min(now[s], INSERT + now[allowed(s)[-1][1]])
        low.append(now)
    low.reverse()
    return low


def search(kinds: str, entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of some turns from one state to another, or to the end of the conversation; None if there are none.

    Equal costs never make one audit a prefix of another, so (cost, audit) is a total order that survives any same suffix;
    a prefix that is no better than another at the same place and state can be dropped. The branch with the least bound, of
    equal ones the least letter, is looked at first.
    """
    n, low = len(kinds), bounds(kinds, goal)
    best: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    incumbent: tuple[int, str] | None = None
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + low[i][state]
        if bound >= NEVER or incumbent and (bound > incumbent[0] or bound == incumbent[0] and audit > incumbent[1][: len(audit)]):
            continue
        if (held := best[i].get(state)) and held <= (cost, audit):
            continue
        best[i][state] = (cost, audit)
        if i == n:
            answer = (bound, audit + CLOSING[state] if goal is None else audit)
            incumbent = min(incumbent or answer, answer)
            continue
        following = [(cost + INSERT, audit + "I", i, allowed(state)[-1][1])]
        following += [(cost + c, audit + letter, i + 1, after) for letter, c, after in edits(kinds[i], state)]
        following.sort(key=lambda x: (x[0] + low[x[2]][x[3]], x[1]), reverse=True)
        stack += [(j, s, c, a) for c, a, j, s in following]
    return incumbent


def ways_through(kinds: str) -> list[Ends]:
    """For each state before a block of turns, the cheapest edits to each state behind it."""
    return [{goal: found for goal in range(4) if (found := search(kinds, entry, goal))} for entry in range(4)]


def chain(blocks: Iterable[list[Ends]]) -> list[tuple[int, str]]:
    """(entry state, audit) of each block of a conversation, from the answers of each block from each state; the closing edits are the last block's."""
    ways: dict[int, tuple[int, str, tuple | None]] = {START: (0, "", None)}
    for ends in blocks:
        after: dict[int, tuple[int, str, tuple | None]] = {}
        for state, (cost, audit, path) in ways.items():
            for end, (c, a) in ends[state].items():
                if end not in after or (cost + c, audit + a) < after[end][:2]:
                    after[end] = (cost + c, audit + a, (path, state, a))
        ways = after
    state = min(ways, key=lambda s: (ways[s][0] + INSERT * len(CLOSING[s]), ways[s][1] + CLOSING[s]))
    path, found = ways[state][2], []
    while path is not None:
        path, entry, audit = path
        found.append((entry, audit))
    found.reverse()
    return [*found[:-1], (found[-1][0], found[-1][1] + CLOSING[state])] if found else []


def played(audit: str, kinds: str, entry: int = START) -> Iterator[tuple[str, int]]:
    """The edits of an audit, and the state after each."""
    state, i = entry, 0
    for letter in audit:
        if letter == "I":
            state = allowed(state)[-1][1]
        else:
            state = next(s for x, _, s in edits(kinds[i], state) if x == letter)
            i += 1
        yield letter, state


ROLE = {USER: "user", ASSISTANT: "assistant"}


def repaired(audit: str, roles: list[str], texts: list[str], kinds: str) -> list[tuple[str, str]]:
    """The (role, text) turns that an audit makes."""
    out, i = [], 0
    for letter, state in played(audit, kinds):
        if letter == "I":
            out.append((ROLE[state], ""))
            continue
        if letter != "D":
            out.append((roles[i] if letter == "K" else ROLE[state], texts[i]))
        i += 1
    return out


def row_edits(audit: str, kinds: str, entry: int) -> list[str]:
    """An audit split by turn: roles' initials inserted before it, its letter (with the new role's initial behind R), and, at the last, those inserted behind."""
    out, now = [""], False
    for letter, state in played(audit, kinds, entry):
        role = ROLE.get(state, "s")[0]
        if letter == "I":
            if now and len(out) < len(kinds):
                out.append("")
                now = False
            out[-1] += role
            continue
        if now:
            out.append("")
        out[-1] += letter + (role if letter == "R" else "")
        now = True
    return out


def faults(kinds: str, blank: list[bool]) -> tuple[int, int, int]:
    """How many turns are blank, duplicate, truncated; each by its first fault."""
    empty = sum(blank)
    return empty, kinds.count("x") - empty, sum(k.isupper() for k in kinds)


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))


def kind_of(initial: str, must_go: bool, cut_short: bool) -> str:
    kind = "x" if must_go else initial if initial in ("s", "u", "a") else "o"
    return kind.upper() if cut_short and not must_go else kind


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cost_of(audit: str, kinds: str) -> int:
    turns = audit.replace("I", "")
    kept = sum(TRUNCATED for letter, kind in zip(turns, kinds, strict=True) if letter != "D" and kind.isupper())
    return INSERT * audit.count("I") + REROLE * audit.count("R") + DELETE * audit.count("D") + kept


def one_conversation(turns: list[dict]) -> tuple[list, list[tuple[str, str]]]:
    """The report and the repaired turns of a conversation whose turns (turn, role, text, blank, cut_short) are in order."""
    seen: set[tuple[str, str]] = set()
    kinds = ""
    for t in turns:
        key = (t["role"], t["text"])
        kinds += kind_of(t["role"][:1], t["blank"] or key in seen, t["cut_short"])
        seen.add(key)
    if len(turns) <= BLOCK:
        audit = search(kinds)[1]
    else:
        parts = [kinds[k : k + BLOCK] for k in range(0, len(kinds), BLOCK)]
        audit = "".join(a for _, a in chain(map(ways_through, parts)))
    out = repaired(audit, [t["role"] for t in turns], [t["text"] for t in turns], kinds)
    numbers = {t["turn"] for t in turns} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    report = [gaps, *faults(kinds, [t["blank"] for t in turns]), illegal([t["role"][:1] for t in turns]), cost_of(audit, kinds), audit]
    return [*report, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode("utf-8", "surrogatepass")).hexdigest()], out


_WORD, _ENDED = r"[^\x20\x09-\x0D]", r"(?s)[.!?][\x20\x09-\x0D]*\z"


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, key (null-safe), turn, role, text, blank, cut_short and dropped (a row that only says that its conversation exists)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    blank = ~text.rlike(_WORD)
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return turns.select("conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), blank.alias("blank"), (~blank & ~text.rlike(_ENDED)).alias("cut_short"), dropped.alias("dropped"))


def _short(rows: DataFrame, id_type: str) -> DataFrame:
    """Reports of the conversations that fit one group, with their repaired turns."""
    turn = F.struct("turn", "role", "text", "blank", "cut_short")
    groups = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.when(~F.col("dropped"), turn))).alias("turns")).select("conv_id", "turns")

    def run(batches):
        for batch in batches:
            found = [one_conversation(turns) for turns in batch.column(1).to_pylist()]
            reports = [pa.array([r[k] for r, _ in found], pa.string() if k > 5 else pa.int64()) for k in range(8)]
            turns = pa.array([[{"role": r, "text": t} for r, t in out] for _, out in found], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *reports, turns], ["conv_id", *_REPORT, "repaired"])

    return groups.mapInArrow(run, f"conv_id {id_type}, {REPORT}, repaired array<struct<role:string,text:string>>")


_WAYS = "array<struct<entry:int,`end`:int,cost:long,audit:string>>"
_WAYS_ARROW = pa.list_(pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _block_ways(groups: DataFrame) -> DataFrame:
    """key, block, kinds (of the turns of the block) with ways: the search from each state to each."""

    def run(batches):
        for batch in batches:
            ways = [[{"entry": s, "end": e, "cost": c, "audit": a} for s, ends in enumerate(ways_through(kinds)) for e, (c, a) in ends.items()] for kinds in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ways, _WAYS_ARROW)], ["key", "block", "kinds", "ways"])

    return groups.select("key", "block", "kinds").mapInArrow(run, f"key string, block long, kinds string, ways {_WAYS}")


def _chained(blocks: DataFrame) -> DataFrame:
    """key, audit, cost and pieces (block, edits of each of its turns): the blocks' answers of each conversation in order."""

    def emit(key, held):
        ends: list[list[Ends]] = []
        for _, _, ways in held:
            table: list[Ends] = [{} for _ in range(4)]
            for w in ways:
                table[w["entry"]][w["end"]] = (w["cost"], w["audit"])
            ends.append(table)
        way = chain(ends)
        pieces = [{"block": b, "edits": row_edits(audit, kinds, entry)} for (b, kinds, _), (entry, audit) in zip(held, way, strict=True)]
        return key, "".join(a for _, a in way), sum(cost_of(a, kinds) for (_, kinds, _), (_, a) in zip(held, way, strict=True)), pieces

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != key:
                    yield told(emit(key, held))
                    held = []
                key = row[0]
                held.append(row[1:])
        if held:
            yield told(emit(key, held))

    def told(row):
        kind = pa.list_(pa.struct([("block", pa.int64()), ("edits", pa.list_(pa.string()))]))
        return pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]]), pa.array([row[2]], pa.int64()), pa.array([row[3]], kind)], ["key", "audit", "cost", "pieces"])

    in_order = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "block", "kinds", "ways")
    return in_order.mapInArrow(run, "key string, audit string, cost long, pieces array<struct<block:long,edits:array<string>>>")


def _hashed(lines: DataFrame) -> DataFrame:
    """key and repaired_sha256 of the lines (key, at, lines) of each conversation, as a sorted stream."""

    def run(batches):
        key, digest, begun = None, None, False
        for batch in batches:
            for k, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])
                    key, digest, begun = k, hashlib.sha256(), False
                for line in lines:
                    digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                    begun = True
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])

    return lines.repartition("key").sortWithinPartitions("key", "at").select("key", "lines").mapInArrow(run, "key string, repaired_sha256 string")


def _inserted(initials: Column) -> Column:
    """Turns without text for a string of role initials."""
    each = F.filter(F.split(initials, ""), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))


def _long_turns(rows: DataFrame) -> DataFrame:
    """The kept rows of long conversations with at (their order over all partitions), block, and duplicate."""
    order = ["key", "turn", "role", "text", "salt"]
    salted = rows.filter(~F.col("dropped")).withColumn("salt", F.monotonically_increasing_id())  # parts equal rows of a range
    placed = cut(salted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("digest", F.sha2("text", 256)), "turns")
    first = placed.groupBy("key", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    return cut(placed.join(first, "at", "left").select("key", "at", F.floor(F.col("at") / BLOCK).alias("block"), "turn", "role", "text", "blank", "cut_short", (F.col("first").isNull() & ~F.col("blank")).alias("duplicate")), "marked")


def _long(rows: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame]:
    """Reports of the long conversations, and their repaired turns (key, at, repaired: an array for each turn before)."""
    turns = _long_turns(rows)
    initial = F.left("role", F.lit(1))
    kind = F.when(F.col("blank") | F.col("duplicate"), "x").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    kind = F.when(F.col("cut_short") & (kind != "x"), F.upper(kind)).otherwise(kind)
    coded = turns.select("key", "block", "at", "turn", initial.alias("initial"), kind.alias("kind"), "blank", "duplicate")
    in_order = F.array_sort(F.collect_list(F.struct("at", "kind", "initial")))  # BLOCK turns at most, without texts
    grouped = coded.groupBy("key", "block").agg(in_order.alias("t"), F.min("at").alias("begins"))
    blocks = cut(grouped.select("key", "block", "begins", F.array_join(F.transform("t", lambda x: x["kind"]), "").alias("kinds"), F.transform("t", lambda x: x["initial"]).alias("initials")), "blocks")
    chained = cut(_chained(cut(_block_ways(blocks), "ways")), "chained")
    pieces = chained.select("key", F.explode("pieces").alias("p")).select("key", "p.block", "p.edits").join(blocks.select("key", "block", "begins"), ["key", "block"])
    edited = turns.join(pieces, ["key", "block"]).withColumn("e", F.get("edits", (F.col("at") - F.col("begins")).cast("int")))
    parts = [F.regexp_extract("e", "^([ua]*)([KD]|R[ua])([ua]*)$", k) for k in (1, 2, 3)]
    new_role = F.when(parts[1] == "K", F.col("role")).otherwise(F.when(F.right(parts[1], F.lit(1)) == "u", "user").otherwise("assistant"))
    own = F.filter(F.array(F.when(parts[1] != "D", F.struct(new_role.alias("role"), F.col("text").alias("text")))), lambda x: x.isNotNull())
    made = cut(edited.select("key", "at", F.concat(_inserted(parts[0]), own, _inserted(parts[2])).alias("repaired")), "repaired")
    hashed = _hashed(made.select("key", "at", F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])).alias("lines")))
    # Illegal neighbours within blocks, and from each block to the next of its conversation.
    pair = F.transform(F.sequence(F.lit(1), F.size("initials") - 1), lambda i: F.concat(F.get("initials", i - 1), F.get("initials", i)))
    within = F.when(F.size("initials") > 1, F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    edges = F.array_sort(F.collect_list(F.struct("block", F.get("initials", F.lit(0)).alias("a"), F.element_at("initials", -1).alias("b"))))
    across = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.concat(F.get("edges", i - 1)["b"], F.get("edges", i)["a"]))
    joints = blocks.groupBy("key").agg(F.sum(within).alias("within"), edges.alias("edges"))
    legal = joints.select("key", (F.col("within") + F.when(F.size("edges") > 1, F.size(F.filter(across, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)).cast("long").alias("illegal"))
    distinct = coded.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = coded.groupBy("key").agg(F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"), F.count_if(F.col("kind").rlike("[A-Z]")).alias("truncated"))
    report = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    for side in (distinct, counts, legal, chained.select("key", "cost", "audit"), hashed):
        report = report.join(side, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _REPORT[:6]]
    filled = report.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return filled, made


def repair(turns: DataFrame, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation (conv_id, the columns of REPORT), and the repaired turns: conv_id, at (their order), role, text.

    turns: conv_id, turn, role, text, and optionally dropped: rows that only say that their conversation exists.
    """
    ship(turns.sparkSession)
    rows, id_type = marked(turns), turns.schema["conv_id"].dataType.simpleString()
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = cut(sizes.filter((F.col("n") > group_rows) | (F.col("bytes") > group_bytes)).select("key"), "long")
    many = long.count()
    short = rows if not many else rows.join(bounded_broadcast(long, many), "key", "left_anti")
    done = _short(short, id_type)
    in_order = done.select("conv_id", F.posexplode("repaired").alias("at", "t")).select("conv_id", F.col("at").cast("long").alias("at"), "t.role", "t.text")
    if not many:
        return done.drop("repaired"), in_order
    mine = rows.join(bounded_broadcast(long, many), "key", "left_semi")
    report, made = _long(mine, id_type)
    ids = mine.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    more = made.join(bounded_broadcast(ids, many), "key").select("conv_id", "at", F.posexplode("repaired").alias("i", "t")).select("conv_id", (F.col("at") * (2 * BLOCK + 8) + F.col("i")).alias("at"), "t.role", "t.text")
    return done.drop("repaired").unionByName(report), in_order.unionByName(more)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped after the damage that crc32 of conv_id:turn, modulo 20, decides; nulls are one space in role, text and that name."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    told = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = told.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("dropped"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))[0]


_GAP = r"[\x20\x09-\x0D]"
#: The same by dynamic programming: for each turn and role state the least (cost, audit), all conversations at once.
ORACLE_SQL = rf"""
with recursive given as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
names as (select distinct name as x from given), {crc32("names")},
hurt as (select conv_id, turn, case when crc % 20 = 4 then 'user' else role end as role, case crc % 20 when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when crc % 20 = 3 then [1, 2] else [1] end) as copy
   from given join crc on x = name where crc % 20 > 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?]{_GAP}*$') as open_end from hurt),
t as materialized (select conv_id, i, turn, role, text, role[1:1] as initial, blank, not blank and nth > 1 as duplicate, not blank and nth = 1 and open_end as truncated from (select *, row_number() over (partition by conv_id, role, text order by i) as nth from placed)),
n as (select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated from t group by 1),
ill as (select a.conv_id, count(*) as illegal from t a join t b on a.conv_id is not distinct from b.conv_id and b.i = a.i + 1 where a.initial || b.initial not in ('su', 'ua', 'au') group by 1),
ins(state, added, letters, reached) as (values (0, 0, '', 0), (0, 3, 'I', 2), (0, 6, 'II', 3), (1, 0, '', 1), (1, 3, 'I', 2), (1, 6, 'II', 3), (2, 0, '', 2), (2, 3, 'I', 3), (3, 0, '', 3), (3, 3, 'I', 2)),
walk as (select conv_id, 0::bigint as i, 0 as state, {{'c': 0::bigint, 'a': ''}} as best from n
  union all select conv_id, i, state, min(best) as best from (
    select w.conv_id, t.i, case e.letter when 'D' then reached else e.after end as state, {{'c': best.c + added + e.cost + case when truncated and letter <> 'D' then 3 else 0 end, 'a': best.a || letters || letter}} as best
    from walk w join ins using (state) join t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1
    join (values (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2), (0, 'R', null, 3, 2), (1, 'R', null, 3, 2), (2, 'R', null, 3, 3), (3, 'R', null, 3, 2),
      (0, 'D', null, 4, 0), (1, 'D', null, 4, 1), (2, 'D', null, 4, 2), (3, 'D', null, 4, 3)) e(came, letter, wanted, cost, after)
      on came = reached and (letter = 'D' or not blank and not duplicate) and coalesce(wanted = initial, true)) group by all),
done as materialized (select conv_id, min({{'c': best.c + 3 * len(x), 'a': best.a || x}}) as best from (select w.conv_id, w.best, case state when 1 then 'II' when 2 then 'I' else '' end as x from walk w join n on n.conv_id is not distinct from w.conv_id where i = n) group by 1),
letters as (select conv_id, best.a as a, unnest(range(1, len(best.a) + 1)) as p from done),
parts as (select conv_id, p, a[p] as letter, len(replace(a[1:p], 'I', '')) as i, len(replace(a[1:p], 'D', '')) as place from letters),
kept as (select parts.*, t.role, t.text, bool_or(place = 1 and letter = 'K' and t.initial = 's') over (partition by parts.conv_id) as s from parts left join t on t.conv_id is not distinct from parts.conv_id and t.i = parts.i where letter <> 'D'),
lines as (select conv_id, string_agg(case letter when 'K' then role else case when (place - s::int) % 2 = 1 then 'user' else 'assistant' end end || ':' || case letter when 'I' then '' else text end, chr(10) order by p) as lines from kept group by 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join n on n.conv_id is not distinct from o.conv_id left join ill on ill.conv_id is not distinct from o.conv_id
  left join done on done.conv_id is not distinct from o.conv_id left join lines on lines.conv_id is not distinct from o.conv_id"""
