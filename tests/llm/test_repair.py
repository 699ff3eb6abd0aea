"""Conversation repair against a plain version: conversation by conversation, edits by trying all."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import queries, repair

DATA = "/root/testdata/sf0.001"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(roles, faults):
    """(cost, audit) by a table of states, row by row; insertions before each row and at the end."""

    def inserted(table):
        for _ in range(4):
            for state, to in ((0, 2), (1, 2), (2, 3), (3, 2)):
                if state in table:
                    offer(table, to, table[state][0] + 2, table[state][1] + "I")
        return table

    def offer(table, state, cost, audit):
        if state not in table or (cost, audit) < table[state]:
            table[state] = cost, audit

    table = inserted({0: (0, "")})
    for role, fault in zip(roles, faults):
        ahead = {}
        for state, (cost, audit) in table.items():
            offer(ahead, state, cost + 3, audit + "D")
            if fault in (None, "truncated"):
                more = fault == "truncated"
                for kind, frm, to in (("s", (0,), 1), ("u", (0, 1, 3), 2), ("a", (2,), 3)):
                    if state in frm:
                        if kind == role[:1]:
                            offer(ahead, to, cost + more, audit + "K")
                        if kind != "s":
                            offer(ahead, to, cost + 2 + more, audit + "R")
        table = inserted(ahead)
    return min(table[s] for s in (0, 3) if s in table)


def all_edits(roles, faults):
    """(cost, audit) by trying every edit of every row, with up to two insertions at each place."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    for edits in itertools.product(*options):
        for ins in itertools.product(inserts, repeat=len(roles) + 1):
            out, audit, cost = ins[0], "I" * len(ins[0]), 2 * len(ins[0])
            for role, fault, edit, more in zip(roles, faults, edits, ins[1:]):
                out += {"D": "", "K": role[:1] or "?", "Ru": "u", "Ra": "a"}[edit] + more
                audit += edit[0] + "I" * len(more)
                cost += {"D": 3, "K": 0, "Ru": 2, "Ra": 2}[edit] + (edit != "D" and fault == "truncated") + 2 * len(more)
            if GRAMMAR.fullmatch(out) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def plain(rows):
    """The contract, conversation by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return [(conv, *summary(own)) for conv, own in convs.items()]


def summary(own):
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in own:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in own if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    roles = [r for _, r, _ in own]
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit = cheapest(roles, faults)
    out, at, before = [], 0, ""
    for letter in audit:
        new = "assistant" if before == "u" else "user"
        if letter == "I":
            out.append((new, ""))
        else:
            _, role, text = own[at]
            at += 1
            if letter == "D":
                continue
            out.append((new if letter == "R" else role, text))
        before = out[-1][0][0]
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in out))
    digest = sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def key(row):
    return str(tuple(row))


def run(spark, folder, rows, **extra):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return sorted(map(key, queries.QUERIES["op11_conversation_repair"](spark, str(folder)).collect()))


def test_table_of_states_is_the_least_of_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        roles = [rng.choice(["s", "u", "a", "x", ""]) for _ in range(n)]
        faults = [rng.choice([None, None, "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert cheapest(roles, faults) == all_edits(roles, faults)


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_grammar_and_chunks_change_nothing(spark, monkeypatch, chunk):
    rng = random.Random(chunk)
    kinds = ["s", "u", "a", "x"]
    faults = [None, "blank", "duplicate", "truncated"]
    lots = [[rng.choice([0, 4, 8, 4, 8, 4, 8, 7, 11, 12, 5, 10]) for _ in range(rng.randint(0, 40))] for _ in range(300)]
    lots += [[4, 8] * 60, [4] * 61, [8] * 33, [0] * 5, [4, 4, 8, 8] * 9]
    df = spark.createDataFrame([(bytearray(s),) for s in lots], "symbols binary")
    rules = repair.grammar(df)
    assert sum(map(len, rules)) > 20
    for s in lots:
        left = repair.compressed(np.array(s, np.int32), rules)
        assert len(left) <= max(1, len(s)) and (len(left) < len(s) / 8 or s != [4, 8] * 60)
        for used in (rules, []):
            planner = repair.Planner(used)
            cost, audits = planner.plan([bytes(s[k : k + chunk]) for k in range(0, max(len(s), 1), chunk)])
            assert (cost, "".join(audits)) == cheapest([kinds[x // 4] for x in s], [faults[x % 4] for x in s])


def test_ropes_compare_as_strings():
    rng = random.Random(2)
    made = [repair.Rope(letter=c) for c in "DIKR"]
    for _ in range(400):
        made.append(rng.choice(made[-30:]) + rng.choice(made))
    some = [(r, str(r)) for r in made if r.size < 5000]
    for _ in range(4000):
        (a, x), (b, y) = rng.choice(some), rng.choice(some)
        assert (a < b) == (x < y) and a.size == len(x)


def test_damage_nulls_ties_and_extra_columns(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "Whole.", "Cut", "Really?! ", "é…", "a\x0b", "Same.", "Same."]
    roles = ["system", "user", "assistant", None, "", "tool", "USER", "u"]
    rows = []
    for conv in range(400):
        size = rng.randint(1, 9)
        turns = [rng.choice([None, k, k, k, k + 3, 0]) for k in range(size)]
        rows += [(conv, t, rng.choice(roles[: rng.choice([3, 8])]), rng.choice(texts)) for t in turns]
    rows += rows[:60] * 2  # repeated rows
    rows += [(None, k, "user", "Nobody's.") for k in (3, None, 4)]
    rows += [(-5, 2**40, "user", "Long " * 300_000), (-5, -(2**40), "user", "Long " * 300_000)]
    rng.shuffle(rows)
    want = sorted(map(key, plain(rows)))
    extra = {c: "mine" for c in ("conv", "copies", "digest", "chunk", "kind", "report", "there", "nth", "fault", "place", "edit", "ends", "audit")}
    assert run(spark, tmp_path, rows, **extra) == want
    assert any("'', 'e3b0c44298fc1c14" in w for w in want)  # nothing is left of some
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(str, con.execute(repair.oracle_sql()).fetchall())) == want


def test_long_conversation_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 64)
    rng = random.Random(8)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One.", "Two", f"{k}.", f"{k}", " "])) for k in range(3000)]
    rows += [(2, 5, "user", "Again.")] * 700 + [(3, k, "user", "Same.") for k in range(500)]
    assert run(spark, tmp_path, rows) == sorted(map(key, plain(rows)))


def test_empty_table_and_messages(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    df = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Hm"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "")], "c long, t int, r string, x string")
    got = repair.repair(df, "c", "t", "r", "x").orderBy("c", F.col("place").asc_nulls_last()).collect()
    # to drop the second question costs as much as to answer it, and its audit comes first
    told = [(r["c"], r["place"], r["role"], r["text"], r["edit"], r["cost"], r["audit"]) for r in got]
    assert told == [
        (1, 0, "user", "Hello.", "K", None, None),
        (1, 1, "assistant", "Yes.", "K", None, None),
        (1, None, None, None, None, 3, "KDK"),
        (2, None, None, None, None, 3, "D"),
    ]
    assert repair.repair(df.limit(0), "c", "t", "r", "x").collect() == []


def test_op11_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(key, queries.QUERIES["op11_conversation_repair"](spark, DATA).collect()))
    assert got == sorted(map(key, plain(rows)))
