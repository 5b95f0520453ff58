"""Conversation structure repair: cheapest edits by Hirschberg's divide and conquer.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Four states say
where a reader stands: nothing read, after the system turn, after user, after assistant.
Every row takes a state to another at a cost, so a row, and a run of rows, is a 4 x 4
table of cheapest costs. The run is cut in the middle, forward costs from the left end
meet backward costs from the right end there, the crossing state is chosen, and both
halves are solved alike: memory is linear in the rows. Among states of equal cost the
one with the ASCII-least edits wins. That needs no edit strings: edits that end with a
row's own edit are never a start of each other, so the rank of the four least strings
follows from the ranks before (an insertion belongs to the row after it).

Rows are range-sorted by conversation and turn, so that a conversation of any size is
dealt over many tasks, and cut into blocks of at most ``BLOCK`` rows. Conversations that
lie in one block are solved there. For the others the same recursion runs over tables:
the blocks of a conversation in one partition, then its partitions (at most one row a
partition), and the chosen states go down again.

Rows alike in conversation, turn, role and text are one counted row, so copies meet in no
group; whether a role and text occurred at an earlier turn comes from a combined minimum.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_table, parts_of, read

#: Rows of a block.
BLOCK = 2048
#: Characters of a text that the range partitioner sees.
_PREFIX = 32
#: White space of the contract, and the marks that end a sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
FREE, BLANK, DUPLICATE, TRUNCATED = range(4)
NONE, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
#: The role that may follow a state, and the state it leads to.
_NEXT = {NONE: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
_LEGAL = {"su", "ua", "au"}


# ------------------------------------------------------------------ one row ---

def _edits(state: int, initial: str, fault: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits of a row in a state, without insertions."""
    out = [(3, "D", state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = int(fault == TRUNCATED)
    wanted, then = _NEXT[state]
    out.append((2 + more, "R", then))
    if initial == wanted:
        out.append((more, "K", then))
    if initial == "s" and state == NONE:
        out.append((more, "K", SYSTEM))
    return out


def _paths(state: int, initial: str, fault: int) -> list[tuple[int, str, int]]:
    """Edits of a row with the insertions before it; more than two would come round to a state again."""
    out, at = [], state
    for k in range(3):
        out += [(2 * k + cost, "I" * k + letter, then) for cost, letter, then in _edits(at, initial, fault)]
        at = _NEXT[at][1]
    return out


_LETTERS: dict[tuple, tuple[list, list]] = {}


def row_table(initial: str, fault: int, copies: int) -> tuple[tuple, list]:
    """Costs and ranks ``table[s][t] = (cost, rank)`` of a row, and its letters ``[s][t]``.

    Copies beyond the first are duplicates (of a blank row: blanks) and go.
    """
    key = (initial if initial in "sua" else "?", fault, copies)
    if key not in _LETTERS:
        table, letters = [], []
        for s in range(4):
            best: dict[int, tuple] = {}
            for cost, word, t in _paths(s, key[0], fault):
                best[t] = min(best.get(t, (INF, "")), (cost, word))
            order = sorted(best, key=lambda t: best[t][1])
            table.append(tuple((best[t][0] + 3 * (copies - 1), order.index(t)) if t in best else (INF, 9) for t in range(4)))
            letters.append([best[t][1] + "D" * (copies - 1) if t in best else "" for t in range(4)])
        _LETTERS[key] = (tuple(table), letters)
    return _LETTERS[key]


# ------------------------------------------------------- runs of rows or blocks ---

IDENTITY = tuple(tuple((0, 0) if s == t else (INF, 9) for t in range(4)) for s in range(4))


def step(costs: tuple, ranks: tuple, table: tuple) -> tuple[tuple, tuple]:
    """Forward: cheapest costs of the four states after one more table, and the ranks of the least strings."""
    found = []
    for t in range(4):
        found.append(min((costs[s] + table[s][t][0], ranks[s], table[s][t][1]) for s in range(4)))
    order = sorted(range(4), key=lambda t: found[t][1:] if found[t][0] < INF else (9, 9))
    out = [9] * 4
    for r, t in enumerate(order):
        if found[t][0] < INF:
            out[t] = r
    return tuple(min(f[0], INF) for f in found), tuple(out)


def back(costs: tuple, table: tuple) -> tuple:
    return tuple(min(INF, min(table[s][t][0] + costs[t] for t in range(4))) for s in range(4))


class Memo:
    """``step`` and ``back`` of vectors less their least cost; few such vectors occur, so a row is a look-up."""

    LIMIT = 1 << 16

    def __init__(self):
        self.forth: dict = {}
        self.away: dict = {}

    def step(self, costs, ranks, table):
        low = min(costs)
        key = (tuple(c - low if c < INF else INF for c in costs), ranks, table)
        got = self.forth.get(key)
        if got is None:
            if len(self.forth) > self.LIMIT:
                self.forth.clear()
            got = self.forth[key] = step(*key)
        return tuple(c + low if c < INF else INF for c in got[0]), got[1]

    def back(self, costs, table):
        low = min(costs)
        key = (tuple(c - low if c < INF else INF for c in costs), table)
        got = self.away.get(key)
        if got is None:
            if len(self.away) > self.LIMIT:
                self.away.clear()
            got = self.away[key] = back(*key)
        return tuple(c + low if c < INF else INF for c in got)


def from_state(s: int) -> tuple[tuple, tuple]:
    return tuple(0 if t == s else INF for t in range(4)), tuple(0 if t == s else 9 for t in range(4))


def run_table(tables: list[tuple], memo: Memo) -> tuple:
    """The table of a run of tables."""
    out = []
    for s in range(4):
        costs, ranks = from_state(s)
        for table in tables:
            costs, ranks = memo.step(costs, ranks, table)
        out.append(tuple(zip(costs, ranks, strict=True)))
    return tuple(out)


#: Costs of ending in a state: insertions up to an accepted end.
END = (0, 4, 2, 0)


def last_state(costs: tuple, ranks: tuple) -> int:
    """State after the last row of the cheapest, then ASCII-least reading."""
    return min(range(4), key=lambda s: (costs[s] + END[s], ranks[s]))


def crossings(tables: list[tuple], s_in: int, s_out: int, memo: Memo) -> list[int]:
    """States before, between and after the tables on the best way from s_in to s_out (Hirschberg)."""
    states = [0] * (len(tables) + 1)
    states[0], states[-1] = s_in, s_out
    todo = [(0, len(tables))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        costs, ranks = from_state(states[lo])
        for table in tables[lo:mid]:
            costs, ranks = memo.step(costs, ranks, table)
        rest = from_state(states[hi])[0]
        for table in tables[hi - 1:mid - 1:-1]:
            rest = memo.back(rest, table)
        states[mid] = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
        todo += [(lo, mid), (mid, hi)]
    return states


def solve(tables: list[tuple], memo: Memo, s_in: int = NONE, s_out: int | None = None) -> list[int]:
    """All states of a run; without s_out the run is the end of its conversation."""
    if s_out is None:
        costs, ranks = from_state(s_in)
        for table in tables:
            costs, ranks = memo.step(costs, ranks, table)
        s_out = last_state(costs, ranks)
    return crossings(tables, s_in, s_out, memo)


def edits(rows: list[tuple[str, int, int]], states: list[int]) -> list[str]:
    """Letters of each (initial, fault, copies) on its way through the states."""
    return [row_table(*r)[1][a][b] for r, a, b in zip(rows, states[:-1], states[1:], strict=True)]


def tail(state: int) -> str:
    """Insertions after the last row."""
    return "I" * (END[state] // 2)


def pack(table: tuple) -> bytes:
    return struct.pack("<32q", *(x for row in table for cell in row for x in cell))


def unpack(raw: bytes) -> tuple:
    flat = struct.unpack("<32q", raw)
    return tuple(tuple((flat[8 * s + 2 * t], flat[8 * s + 2 * t + 1]) for t in range(4)) for s in range(4))


# ------------------------------------------------------------------ on Spark ---

def _blank(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, "")) == 0


def fault_column(text: Column, repeated: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated or none."""
    ended = F.rtrim(F.translate(text, SPACE[1:], " " * 5)).rlike(r"[.!?]\z")
    return F.when(_blank(text), BLANK).when(repeated, DUPLICATE).when(~ended, TRUNCATED).otherwise(FREE)


def faults(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies, fault): rows alike are one row; nulls of role and text are one space."""
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    counted = plain.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    first = plain.groupBy("conv", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    c, f = counted.alias("c"), first.alias("f")
    same = F.col("c.conv").eqNullSafe(F.col("f.conv")) & (F.col("c.role") == F.col("f.role")) & (F.col("c.text") == F.col("f.text"))
    later = ~F.col("c.turn").eqNullSafe(F.col("f.first.turn"))
    return c.join(f, same).select("c.*", fault_column(F.col("c.text"), later).alias("fault"))


_NUMBERED = "part int, block int, pos int, letters string, states binary, edge binary"


def number(found: DataFrame) -> DataFrame:
    """Rows in order as (part, block, pos), with the edits of conversations that lie in one block.

    The last row of a block of any other conversation has the block's table in ``edge``.
    """
    prefix = F.substring("text", 1, _PREFIX)
    dealt = found.repartitionByRange(parts_of(found.sparkSession), F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", prefix)
    ordered = dealt.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    names = ordered.columns
    at = {c: names.index(c) for c in ("conv", "role", "fault", "copies")}
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ordered.schema.fields)}, {_NUMBERED}"

    def run(batches):
        from pyspark import TaskContext

        part, memo = TaskContext.get().partitionId(), Memo()
        held, block, before = [], 0, object()       # slices of the block at hand, its number, the conversation before

        def close(edge: bool):
            nonlocal block
            rows = [r for _, own in held for r in own]
            tables = [row_table(*r)[0] for r in rows]
            done, letters, states = None, [None] * len(rows), [None] * len(rows)
            if edge:
                done = pack(run_table(tables, memo))
            else:
                ways = solve(tables, memo)
                letters = edits(rows, ways)
                letters[-1] += tail(ways[-1])
                states = [bytes(w) for w in zip(ways, ways[1:], strict=False)]
            start = 0
            for got, own in held:
                n = len(own)
                end = [None] * n
                if edge and start + n == len(rows):
                    end[-1] = done
                yield pa.RecordBatch.from_arrays(
                    [*got.columns, pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(start, start + n), pa.int32()),
                     pa.array(letters[start:start + n], pa.string()), pa.array(states[start:start + n], pa.binary()), pa.array(end, pa.binary())],
                    [*names, "part", "block", "pos", "letters", "states", "edge"])
                start += n
            held.clear()
            block += 1

        def joined(pieces):
            return pa.Table.from_batches(pieces).combine_chunks().to_batches()

        size, first, cut = 0, True, False           # rows held; is this the first conversation here; was it cut before
        for got in batches:
            convs = got.column(at["conv"]).to_pylist()
            facts = list(zip([r[:1] for r in got.column(at["role"]).to_pylist()], got.column(at["fault"]).to_pylist(), got.column(at["copies"]).to_pylist(), strict=True))
            lo, ready = 0, []
            while lo < len(convs):
                if held and convs[lo] != before:    # the conversation at hand is complete
                    ready += close(edge=first or cut)
                    size, first, cut = 0, False, False
                elif held and size == BLOCK:
                    ready += close(edge=True)
                    size, cut = 0, True
                before = convs[lo]
                hi, most = lo + 1, lo + BLOCK - size
                while hi < len(convs) and hi < most and convs[hi] == before:
                    hi += 1
                held.append((got.slice(lo, hi - lo), facts[lo:hi]))
                size += hi - lo
                lo = hi
            if ready:
                yield from joined(ready)
        if held:
            yield from close(edge=True)             # it may go on in the next partition

    return ordered.mapInArrow(run, schema)


def _solve_level(level: DataFrame, over: list[str], below: str, known: DataFrame | None) -> DataFrame:
    """(*over, below, s_in, s_out) for the members of each group; ``known`` has (s_in, s_out) of the groups."""
    members = level.groupBy(*over).agg(F.sort_array(F.collect_list(F.struct(below, "edge"))).alias("members"))
    if known is None:
        members = members.withColumns({"s_in": F.lit(NONE), "s_out": F.lit(None).cast("int")})
    else:
        joined = [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in over]
        members = members.alias("m").join(known.alias("k"), joined).select("m.*", "k.s_in", "k.s_out", "k.final")
    kinds = dict(level.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in over)

    def run(batches):
        memo = Memo()
        for got in batches:
            rows = got.to_pylist()
            out = {c: [] for c in (*over, below, "s_in", "s_out", "final")}
            for r in rows:
                tables = [unpack(m["edge"]) for m in r["members"]]
                states = solve(tables, memo, r["s_in"], r["s_out"])
                last = r.get("final", True)
                for i, m in enumerate(r["members"]):
                    for c in over:
                        out[c].append(r[c])
                    out[below].append(m[below])
                    out["s_in"].append(states[i])
                    out["s_out"].append(states[i + 1])
                    out["final"].append(last and i + 1 == len(tables))
            types = {f.name: f.type for f in got.schema}
            arrays = [pa.array(out[c], types[c]) for c in over] + [pa.array(out[c], pa.int32()) for c in (below, "s_in", "s_out")] + [pa.array(out["final"], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*over, below, "s_in", "s_out", "final"])

    return members.mapInArrow(run, f"{head}, `{below}` int, s_in int, s_out int, final boolean")


def _combine(blocks: DataFrame) -> DataFrame:
    """The table of a conversation's blocks in one partition."""
    kind = dict(blocks.dtypes)["conv"]
    members = blocks.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("block", "edge"))).alias("members"))

    def run(batches):
        memo = Memo()
        for got in batches:
            made = [pack(run_table([unpack(m["edge"]) for m in own], memo)) for own in got.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(made, pa.binary())], ["conv", "part", "edge"])

    return members.mapInArrow(run, f"conv {kind}, part int, edge binary")


def plan(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies, fault, part, block, pos, letters, states): rows with their edits.

    (part, block, pos) is the order. ``letters`` has a row's edits, insertions before it and
    deletions of its copies included; after the last row it also has the insertions at the end.
    ``states`` holds the states before and after a row. Null conversations are one conversation,
    null turns come first, rows of one turn go by role, then text; null roles and texts are one
    space. Other columns are left out, whatever their names. An empty table has no rows.
    """
    spark = rows.sparkSession
    numbered = checkpoint_table(number(faults(rows, conv, turn, role, text)), spark, "repair-rows")
    blocks = checkpoint_table(numbered.where("edge IS NOT NULL").select("conv", "part", "block", "edge"), spark, "repair-blocks")
    runs = _combine(blocks)
    of_runs = _solve_level(runs, ["conv"], "part", None)
    of_blocks = _solve_level(blocks, ["conv", "part"], "block", of_runs)
    items = F.sort_array(F.collect_list(F.struct("pos", F.substring("role", 1, 1).alias("initial"), "fault", "copies"))).alias("items")
    cut = numbered.where("letters IS NULL").groupBy("part", "block").agg(F.first("conv").alias("conv"), items)
    cut = cut.join(of_blocks.drop("conv"), ["part", "block"]).select("part", "block", "items", "s_in", "s_out", "final")

    def run(batches):
        memo = Memo()
        for got in batches:
            out = {c: [] for c in ("part", "block", "pos", "letters", "states")}
            for r in got.to_pylist():
                own = [(i["initial"], i["fault"], i["copies"]) for i in r["items"]]
                ways = solve([row_table(*x)[0] for x in own], memo, r["s_in"], r["s_out"])
                letters = edits(own, ways)
                if r["final"]:
                    letters[-1] += tail(ways[-1])
                out["part"] += [r["part"]] * len(own)
                out["block"] += [r["block"]] * len(own)
                out["pos"] += [i["pos"] for i in r["items"]]
                out["letters"] += letters
                out["states"] += [bytes(w) for w in zip(ways, ways[1:], strict=False)]
            ints = [pa.array(out[c], pa.int32()) for c in ("part", "block", "pos")]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(out["letters"], pa.string()), pa.array(out["states"], pa.binary())], list(out))

    solved = cut.mapInArrow(run, "part int, block int, pos int, letters string, states binary")
    where = ["part", "block", "pos"]
    late = numbered.where("letters IS NULL").drop("letters", "states", "edge").join(solved, where)
    columns = ["conv", "turn", "role", "text", "copies", "fault", *where, "letters", "states"]
    return numbered.where("letters IS NOT NULL").select(*columns).unionByName(late.select(*columns))


def repaired_rows(letters: str, state: int, role: str, text: str) -> list[tuple[str, str]]:
    """(role, text) that a row's edits leave, from the state before it."""
    out = []
    for x in letters:
        wanted, then = _NEXT[state]
        name = "user" if wanted == "u" else "assistant"
        if x == "I":
            out.append((name, ""))
        elif x == "R":
            out.append((name, text))
        elif x == "K":
            out.append((role, text))
            if role[:1] == "s":
                then = SYSTEM
        if x != "D":
            state = then
    return out


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv, part, block, pos, nth, role, text), ordered by part, block, pos, nth."""
    planned = plan(rows, conv, turn, role, text)
    names, kind = planned.columns, dict(planned.dtypes)["conv"]
    at = {c: names.index(c) for c in names}

    def run(batches):
        for got in batches:
            kept, new = [], {"nth": [], "role": [], "text": []}
            cols = [got.column(at[c]).to_pylist() for c in ("letters", "states", "role", "text")]
            for i, (letters, states, own, body) in enumerate(zip(*cols, strict=True)):
                for nth, (r, t) in enumerate(repaired_rows(letters, states[0], own, body)):
                    kept.append(i)
                    new["nth"].append(nth)
                    new["role"].append(r)
                    new["text"].append(t)
            same = [got.column(at[c]).take(pa.array(kept, pa.int64())) for c in ("conv", "part", "block", "pos")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(new["nth"], pa.int32()), pa.array(new["role"], pa.string()), pa.array(new["text"], pa.string())],
                                             ["conv", "part", "block", "pos", "nth", "role", "text"])

    return planned.mapInArrow(run, f"conv {kind}, part int, block int, pos int, nth int, role string, text string")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(planned: DataFrame) -> DataFrame:
    """One row a conversation: faults, illegal neighbours, cost, edits and the hash of what is left.

    A hash can only be taken in order, so the rows of a conversation stream through one task;
    what is held there is a few counters and the edits found so far, which are the result.
    """
    spark = planned.sparkSession
    ordered = planned.repartition(parts_of(spark), "conv").sortWithinPartitions("conv", "part", "block", "pos")
    names, kind = ordered.columns, dict(ordered.dtypes)["conv"]
    at = {c: names.index(c) for c in names}
    wanted = ["conv", "turn", "role", "text", "copies", "fault", "letters", "states"]

    def run(batches):
        now = None

        def fresh_one(conv):
            return {"conv": conv, "low": None, "high": None, "turns": 0, "faults": [0, 0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False, "last": None}

        def row(n):
            gaps = 0 if n["low"] is None else n["high"] - n["low"] + 1 - n["turns"]
            return (n["conv"], gaps, *n["faults"][1:], n["illegal"], n["cost"], "".join(n["audit"]), n["hash"].hexdigest())

        kinds = None
        for got in batches:
            done = []
            kinds = got.schema.field(at["conv"]).type
            for conv, turn, role, text, copies, fault, letters, states in zip(*[got.column(at[c]).to_pylist() for c in wanted], strict=True):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        done.append(row(now))
                    now = fresh_one(conv)
                n = now
                if turn is not None:
                    n["turns"] += turn != n["high"]
                    n["low"], n["high"] = turn if n["low"] is None else n["low"], turn
                n["faults"][fault] += 1
                n["faults"][BLANK if fault == BLANK else DUPLICATE] += copies - 1
                n["illegal"] += (n["last"] is not None and n["last"] + role[:1] not in _LEGAL) + copies - 1
                n["last"] = role[:1]
                n["cost"] += 2 * letters.count("I") + 2 * letters.count("R") + 3 * letters.count("D")
                n["cost"] += fault == TRUNCATED and ("K" in letters or "R" in letters)
                n["audit"].append(letters)
                for r, t in repaired_rows(letters, states[0], role, text):
                    n["hash"].update((("\n" if n["any"] else "") + f"{r}:{t}").encode("utf-8", "surrogatepass"))
                    n["any"] = True
            if done:
                yield _summaries(done, kinds)
        if now is not None:
            yield _summaries([row(now)], kinds)

    return ordered.mapInArrow(run, f"conv {kind}, {_SUMMARY}")


def _summaries(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv", *(x.split()[0] for x in _SUMMARY.split(", "))]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def damage(rows: DataFrame) -> DataFrame:
    """The query's damaged copy of ``conversations``, by the checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20)).alias("how"))
    how = F.col("how")
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return (plain.where(how != 0)
            .withColumn("n", F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those of which nothing is left have zeros."""
    given = read(spark, sf_dir, "conversations")
    found = summary(plan(damage(given))).alias("s")
    every = given.select("conv_id").distinct().alias("e")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("s.conv")), "left")
    return joined.select("e.conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
