import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kernelspark.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def facts(rows):
    """Faults of (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edits; states only as lists of initials read so far."""
    found = facts(rows)
    best = None
    ways = [(0, "", ())]
    for (role, text), fault in [*zip(rows, found, strict=True), ((None, None), None)]:
        longer = []
        for cost, audit, kept in ways:
            for k in range(3):
                for new in itertools.product(("user", "assistant"), repeat=k):
                    c, a, r = cost + 2 * k, audit + "I" * k, kept + tuple((x, "") for x in new)
                    if role is None:
                        longer.append((c, a, r))
                        continue
                    longer.append((c + 3, a + "D", r))
                    if fault not in ("blank", "duplicate"):
                        more = int(fault == "truncated")
                        longer.append((c + more, a + "K", (*r, (role, text))))
                        longer += [(c + 2 + more, a + "R", (*r, (x, text))) for x in ("user", "assistant")]
        # a start of (s?(ua)+)? only, and of equal sequences of initials modulo "ua" the least
        keep = {}
        for way in longer:
            line = "".join(x[0][:1] or "-" for x in way[2])
            if not re.fullmatch(r"s?|s?(ua)*u?", line):
                continue
            key = line[:1] + "|" + line[-1:]
            keep.setdefault(key, []).append(way)
        ways = [w for group in keep.values() for w in sorted(group)[:40]]
    for cost, audit, kept in ways:
        if GRAMMAR.fullmatch("".join(x[0][:1] or "-" for x in kept)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, kept)
    return best


def expected(rows):
    """The contract over (conv, turn, role, text) after damage, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, (" " if r is None else r).encode(), (" " if x is None else x).encode()) for c, t, r, x in rows if c == conv))
        turns = [o[1] for o in own if o[0]]
        plain = [(o[2].decode(), o[3].decode()) for o in own]
        found = facts(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit, kept = cheapest(plain)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)
    return out


def made(seed, convs=60, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why? ", "Fine!\n", "", " \t", None, "a\x0b", f"t{t}.", "é"])
            turn = None if rng.random() < 0.1 else t + rng.choice([0, 0, 0, 3])
            rows += [(c if c else None, turn, role, text)] * rng.choice([1, 1, 1, 1, 3])
    rng.shuffle(rows)
    return rows


def result(rows):
    got = R.summary(R.plan(rows)).collect()
    return {r.conv: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("block", [2048, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = made(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = expected(rows)
    got = result(df)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, [r for r in rows if r[0] == c])


def test_runs_and_blocks_choose_alike():
    rng, memo = random.Random(5), R.Memo()
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 40))]
        tables = [R.row_table(*r)[0] for r in rows]
        whole = R.solve(tables, memo)
        cuts = sorted(rng.sample(range(1, len(rows)), min(3, len(rows) - 1))) if len(rows) > 1 else []
        parts = [tables[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        outer = R.solve([R.unpack(R.pack(R.run_table(p, memo))) for p in parts], memo)
        inner = [outer[0]]
        for p, a, b in zip(parts, outer, outer[1:]):
            inner += R.solve(p, memo, a, b)[1:]
        assert R.edits(rows, whole) + [R.tail(whole[-1])] == R.edits(rows, inner) + [R.tail(inner[-1])]


def test_one_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 64)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Own {t}.", f"Cut {t}", ""])) for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(2, 40) for t in range(4)]
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(7))
    own = sorted((t, r, x) for c, t, r, x in rows if c == 1)
    found = facts([o[1:] for o in own])
    code = {"": R.FREE, "blank": R.BLANK, "duplicate": R.DUPLICATE, "truncated": R.TRUNCATED}
    items = [(o[1][:1], code[f], 1) for o, f in zip(own, found)]
    states = R.solve([R.row_table(*i)[0] for i in items], R.Memo())
    assert got[1][6] == "".join(R.edits(items, states)) + R.tail(states[-1])
    assert got[1][1:4] == tuple(found.count(x) for x in ("blank", "duplicate", "truncated"))
    assert all(got[c][6] == "KKKK" and got[c][5] == 0 for c in range(2, 40))


def test_repaired_rows_fit_the_grammar(spark):
    rows = made(8)
    kept = R.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("part", "block", "pos", "nth").collect()
    lines = {}
    for r in kept:
        lines.setdefault(r.conv, []).append(r.role[:1])
    assert lines and all(GRAMMAR.fullmatch("".join(x)) for x in lines.values())


def test_query_damages_by_checksum(spark, tmp_path):
    rows = made(4, convs=150, longest=6)
    rows += [(900, 0, None, None), (901, None, "user", "x" * 100_000)]
    spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], SCHEMA + ", part int, CONV string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if how == 0:
            continue
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        hurt += [(c, t, "user" if how == 4 else r, x)] * (2 if how == 3 else 1)
    want = expected(hurt)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in R.op13_repair(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


def test_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.summary(R.plan(none)).collect() == [] and R.repair(none).collect() == []
    odd = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Ho.", 6, "y")], SCHEMA + ", part int, Letters string")
    assert R.summary(R.plan(odd)).select("audit").first()[0] == "KK"
    named = odd.select(F.col("conv_id").alias("c"), F.col("turn").alias("fault"), F.col("role").alias("who"), F.col("text").alias("edge"))
    assert R.summary(R.plan(named, "c", "fault", "who", "edge")).select("audit").first()[0] == "KK"
