"""Conversation repair: cheapest edits found over a grammar that conversations share.

A message is a symbol: its role and its first fault.  Re-Pair gives frequent
neighbours a symbol of their own, over all conversations.  Each symbol has one min-plus matrix:
for each two states of the role automaton the least cost of edits that lead
from one to the other, with the audit (the edits' initials) as a rope.  The
matrix of a rule is the product of those of its two symbols and is computed
once; a conversation is the product of the few symbols that are left of it.

Sequences are cut into chunks of CHUNK messages, so a conversation of any
length streams through a task; of a chunk no more is kept than the audits that
may still be part of the best.  Messages stream too, in order, when their edits are
applied.  (A digest of a repaired conversation has to see its messages one
after the other, so a conversation isn't split among tasks.)

Nulls in roles and texts count as one space and null conversations as one of
their own; a null turn comes first.  Messages of one turn stand by role, then by
the digest of their text.  Roles by any name are kept by their initial; what
starts otherwise, and an empty role, must get a new role or go.  Conversations
without messages have empty audits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import SQL_CRC_TABLE, _arrow_schema, checkpointed, sql_crc32, table

SPACE = " \t\n\x0b\x0c\r"
INITIALS = "sua"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Symbols of messages: four kinds of roles by four faults.
TERMINALS = 16
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Adjacent roles that may stand.
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, behind system, user, assistant.
STATES = 4
ENDS = (0, 3)

#: Messages of a chunk.
CHUNK = 4096
#: Rounds of Re-Pair and pairs that become rules in one; what these leave is composed symbol by symbol.
ROUNDS, RULES_A_ROUND = 6, 32
#: Sequences whose rows a task remembers, and bytes of a batch that it gives out.
MEMORY, BATCH_BYTES = 1 << 15, 8 << 20

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


class Rope:
    """A string by its two halves, with a hash that tells it from others of its length."""

    __slots__ = ("size", "hash", "left", "right", "letter")
    MODULUS, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self, left: Rope | None = None, right: Rope | None = None, letter: str = ""):
        self.left, self.right, self.letter = left, right, letter
        if left is None:
            self.size, self.hash = len(letter), ord(letter) if letter else 0
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(self.BASE, right.size, self.MODULUS) + right.hash) % self.MODULUS

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope(self, other)

    def __lt__(self, other: Rope) -> bool:
        """By the first letter that differs; equal parts are skipped by their hash."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or x.size == y.size and x.hash == y.hash:
                continue
            if x.size == y.size == 1:
                return x.letter < y.letter
            if x.size >= y.size and x.left is not None:
                a += [x.right, x.left]
                b.append(y)
            else:
                a.append(x)
                b += [y.right, y.left]
        return bool(b)

    def __str__(self) -> str:
        out, left = [], [self]
        while left:
            x = left.pop()
            if x.left is None:
                out.append(x.letter)
            else:
                left += [x.right, x.left]
        return "".join(out)


NOTHING = Rope()
#: Of a matrix, (cost, audit) by state and state; pairs of states that no edits join are absent.
Row = dict[int, tuple[int, Rope]]
Matrix = list[Row]


def _offer(row: Row, state: int, cost: int, audit: Rope) -> None:
    known = row.get(state)
    if known is None or cost < known[0] or cost == known[0] and audit < known[1]:
        row[state] = cost, audit


def times(row: Row, matrix: Matrix) -> Row:
    out: Row = {}
    for via, (cost, audit) in row.items():
        for state, (more, behind) in matrix[via].items():
            if state not in out or cost + more <= out[state][0]:
                _offer(out, state, cost + more, audit + behind)
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest ways of ``a``, then of ``b``; of equal ones the least audit.

    The least of two parts are the least whole: no cheapest audit between two
    states is the beginning of another, since the rest would be insertions that cost.
    """
    return [times(row, b) for row in a]


def insertions() -> Matrix:
    """As many insertions as take one state to another."""
    once: Matrix = [{2: (INSERT, Rope(letter="I"))}, {2: (INSERT, Rope(letter="I"))}, {3: (INSERT, Rope(letter="I"))}, {2: (INSERT, Rope(letter="I"))}]
    out: Matrix = [{s: (0, NOTHING)} for s in range(STATES)]
    for _ in range(2):
        for row, further in zip(out, product(out, once)):
            for state, (cost, audit) in further.items():
                _offer(row, state, cost, audit)
    return out


def message(symbol: int) -> Matrix:
    """Insertions, then the edit of one message."""
    role, fault = divmod(symbol, 4)
    out: Matrix = [{s: (DELETE, Rope(letter="D"))} for s in range(STATES)]
    if fault in (OK, TRUNCATED):
        more = CUT if fault == TRUNCATED else 0
        moves = {0: [(0, 1)], 1: [(0, 2), (1, 2), (3, 2)], 2: [(2, 3)]}
        for a, b in moves[1] + moves[2]:
            _offer(out[a], b, REROLE + more, Rope(letter="R"))
        for a, b in moves.get(role, []):
            _offer(out[a], b, KEEP + more, Rope(letter="K"))
    return product(insertions(), out)


Rules = list[dict[tuple[int, int], int]]


def matrices(rules: Rules) -> list[Matrix]:
    """One matrix a symbol, of a rule from those of its symbols."""
    out = [message(s) for s in range(TERMINALS)]
    for turn in rules:
        for (a, b), symbol in sorted(turn.items(), key=lambda r: r[1]):
            assert symbol == len(out)
            out.append(product(out[a], out[b]))
    return out


def _sites(symbols: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Where a pair of ``table_`` begins; of a symbol's run with itself every second place."""
    if len(symbols) < 2:
        return np.zeros(0, np.int64)
    hit = table_[symbols[:-1], symbols[1:]] >= 0
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    starts = np.where(np.diff(np.append(-2, at)) > 1, np.arange(len(at)), 0)
    run = np.maximum.accumulate(starts)
    return at[(np.arange(len(at)) - run) % 2 == 0]


def compressed(symbols: np.ndarray, rules: Rules) -> np.ndarray:
    """Symbols with the rules applied, round by round; -1 stands between sequences."""
    size = TERMINALS
    for turn in rules:
        pairs = np.full((size + 1, size + 1), -1, np.int32)  # the last row and column are for -1
        for (a, b), symbol in turn.items():
            pairs[a, b] = symbol
        at = _sites(symbols, pairs)
        if len(at):
            symbols = symbols.copy()
            symbols[at] = pairs[symbols[at], symbols[at + 1]]
            symbols = np.delete(symbols, at + 1)
        size += len(turn)
    return symbols


def _flat(column: pa.Array) -> np.ndarray:
    parts = []
    for raw in column.to_pylist():
        parts += [np.frombuffer(raw, np.uint8).astype(np.int32), np.array([-1], np.int32)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _pair_counts(rules: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = TERMINALS + sum(map(len, rules))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            s = compressed(_flat(batch.column(0)), rules)
            a, b = s[:-1], s[1:]
            both = (a >= 0) & (b >= 0)
            total += np.bincount(a[both] * size + b[both], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()), pa.array(total[at])], ["x", "y", "n"])

    return count


def grammar(sequences: DataFrame, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND) -> Rules:
    """Re-Pair over all sequences (column ``symbols``, a byte each), several pairs in a round.

    A round takes the most frequent pairs that stand twice or more, of which
    none ends with what another begins with, so that no two places overlap.  The
    driver gets the counts of its pairs, at most the symbols squared (36,864).
    """
    rules: Rules = []
    size = TERMINALS
    for _ in range(rounds):
        counts = sequences.select("symbols").mapInArrow(_pair_counts(rules), "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        found = sorted(counts.where("n > 1").collect(), key=lambda r: (-r["n"], r["x"], r["y"]))
        turn: dict[tuple[int, int], int] = {}
        first, second = set(), set()
        for r in found:
            x, y = r["x"], r["y"]
            free = x not in second and y not in first and (x != y or x not in first and y not in second)
            # a pair of a symbol with itself stands alone, its runs are taken by twos
            if free and not any((a == b) and {x, y} & {a} for a, b in turn):
                turn[x, y] = size + len(turn)
                first.add(x)
                second.add(y)
            if len(turn) == a_round:
                break
        if not turn:
            break
        rules.append(turn)
        size += len(turn)
    return rules


def _marked(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    """Rows under own names, with the digest of the text and how often they stand."""
    times_ = copies if copies is not None else F.lit(1)
    out = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        times_.cast("int").alias("copies"),
    )
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _order(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", *more)]


def _sequences(rows: DataFrame) -> DataFrame:
    """Chunks of symbols with their first message's place and, with the last, counts of the conversation.

    Only digests travel.  All windows keep to one dealing of the conversations.
    """
    ended = F.expr(f"trim(trailing '{SPACE}' from text)")
    last = F.right(ended, F.lit(1))
    fault = F.when(ended == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    narrow = rows.select("conv", "turn", "role", "digest", fault.alias("fault"), F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)))).alias("copy"))
    there = narrow.repartition("conv").withColumn("there", F.col("copy") > 0)
    nth = F.row_number().over(W.partitionBy("conv", "role", "digest", "there").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    # equal rows stand in the order in which they were seen
    counted = there.withColumn("nth", nth).sortWithinPartitions(*_order("nth"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"conv {kinds['conv']}, chunk int, symbols binary, turn {kinds['turn']}, role string, digest binary, ends boolean, {COUNTS}"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, any_yet, held, first, chunk = None, False, bytearray(), (None, None, None), 0
        faults, illegal, before, low, high, turns = [0] * 4, 0, None, None, None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "fault", "there", "nth")]
            for c, turn, role, digest, fault, is_there, n in zip(*columns):
                if not any_yet or c != conv:
                    if any_yet:
                        out.append((conv, chunk, bytes(held), *first, True, _gaps(low, high, turns), *faults[1:], illegal))
                    conv, any_yet, held, first, chunk = c, True, bytearray(), (None, None, None), 0
                    faults, illegal, before, low, high, turns = [0] * 4, 0, None, None, None, 0
                if not is_there:
                    continue
                if len(held) == CHUNK:
                    out.append((conv, chunk, bytes(held), *first, False, 0, 0, 0, 0, 0))
                    held, chunk = bytearray(), chunk + 1
                if not held:
                    first = turn, role, digest
                if fault != BLANK and n > 1:
                    fault = DUPLICATE
                faults[fault] += 1
                held.append(4 * (INITIALS.find(role[:1]) if role[:1] and role[:1] in INITIALS else 3) + fault)
                if before is not None and before + role[:1] not in LEGAL:
                    illegal += 1
                before = role[:1]
                if turn is not None:
                    turns += turn != high
                    low, high = (turn if low is None else low), turn
            if len(out) > 4096:
                yield _batch(arrow, out)
                out = []
        if any_yet:
            out.append((conv, chunk, bytes(held), *first, True, _gaps(low, high, turns), *faults[1:], illegal))
        if out:
            yield _batch(arrow, out)

    return counted.mapInArrow(chunks, schema)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _batch(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(arrow, zip(*rows))], schema=arrow)


class Planner:
    """Cheapest edits of sequences that come in chunks."""

    def __init__(self, rules: Rules):
        self.rules, self.matrices, self.known = rules, matrices(rules), {}
        self.insertions = insertions()

    def rows(self, start: int, symbols: bytes) -> dict[int, tuple[int, str]]:
        """(cost, audit) by the state that a chunk ends in; equal sequences are computed once."""
        found = self.known.get((start, symbols))
        if found is None:
            row: Row = {start: (0, NOTHING)}
            for s in compressed(np.frombuffer(symbols, np.uint8).astype(np.int32), self.rules).tolist():
                row = times(row, self.matrices[s])
            found = {state: (cost, str(audit)) for state, (cost, audit) in row.items()}
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[start, symbols] = found
        return found

    def plan(self, chunks: Iterable[bytes]) -> tuple[int, list[str]]:
        """The least cost, and the audit of each chunk."""
        live: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        for symbols in chunks:
            ahead: dict[int, tuple[int, tuple]] = {}
            for start, (cost, path) in live.items():
                for state, (more, audit) in self.rows(start, symbols).items():
                    self._take(ahead, state, cost + more, (path, audit))
            live = ahead
        ends: dict[int, tuple[int, tuple]] = {}
        for start, (cost, path) in live.items():
            for state, (more, audit) in self.insertions[start].items():
                if state in ENDS:
                    self._take(ends, -1, cost + more, (path, str(audit)))
        cost, path = ends[-1]
        audits = []
        while path is not None:
            audits.append(path[1])
            path = path[0]
        audits.reverse()
        closing = audits.pop()
        if audits:
            audits[-1] += closing
        return cost, audits or [closing]

    @staticmethod
    def _take(at: dict, state: int, cost: int, path: tuple) -> None:
        known = at.get(state)
        if known is None or cost < known[0] or cost == known[0] and _before(path, known[1]):
            at[state] = cost, path


def _before(a: tuple | None, b: tuple | None) -> bool:
    """Whether the audit of a path comes before another's; both are of as many chunks."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _plans(sequences: DataFrame, rules: Rules) -> DataFrame:
    """Each chunk with the audit of its messages, the last with the cost of all."""
    schema = StructType([*(f for f in sequences.schema if f.name != "symbols"), *_parse_datatype_string("cost long, audit string")])
    arrow = _arrow_schema(sequences.sparkSession, schema)
    names = [f.name for f in schema][:-2]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planner, out, held, chunks = Planner(rules), [], [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for symbols, *row in zip(batch.column("symbols").to_pylist(), *columns):
                chunks.append(symbols)
                held.append(row)
                if row[names.index("ends")]:
                    cost, audits = planner.plan(chunks)
                    out += [(*r, cost, audit) for r, audit in zip(held, audits)]
                    held, chunks = [], []
            if out:
                yield _batch(arrow, out)
                out = []

    return sequences.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "chunk").mapInArrow(plan, schema)


#: What the stream of repaired messages has; a conversation's last row has its report and no message.
MESSAGES = f"place long, role string, text string, edit string, ends boolean, {COUNTS}, cost long, audit string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Repaired messages (conversation, place, role, text, edit, report) of a stream of audits and messages."""
    conv, any_yet, letters, at, audits, before, place, report = None, False, "", 0, [], "", 0, None
    out, held = [], 0

    def insertions() -> Iterator[tuple]:
        nonlocal at, before, place
        while at < len(letters) and letters[at] == "I":
            before = "assistant" if before == "u" else "user"
            yield conv, place, before, "", "I", None
            before, at, place = before[0], at + 1, place + 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "report")]
        for c, kind, role, text, told in zip(*columns):
            if not any_yet or c != conv:
                if any_yet:
                    out += [*insertions(), (conv, None, None, None, None, (report, "".join(audits)))]
                conv, any_yet, letters, at, audits, before, place, report = c, True, "", 0, [], "", 0, None
            if kind == 0:
                letters, at = letters[at:] + told["audit"], 0
                audits.append(told["audit"])
                report = told
                continue
            out += insertions()
            edit, at = letters[at], at + 1
            if edit != "D":
                if edit == "R":
                    role = "assistant" if before == "u" else "user"
                out.append((conv, place, role, text, edit, None))
                before, place, held = role[:1], place + 1, held + len(text)
            if held > BATCH_BYTES:
                yield out
                out, held = [], 0
        if out:
            yield out
            out, held = [], 0
    if any_yet:
        yield [*insertions(), (conv, None, None, None, None, (report, "".join(audits)))]


def _stream(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Messages in order, before the first of each chunk its audit."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    told = F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    messages = rows.where("copies > 0").select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), F.lit(0).alias("chunk"), "text", copies.alias("copy")).drop("copy")
    audits = plans.select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), "chunk", F.lit(None).cast("string").alias("text"), told.alias("report"))
    both = audits.unionByName(messages, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions(*_order("kind", "chunk"))


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    marked = _marked(rows, conv, turn, role, text, copies)
    sequences = checkpointed(_sequences(marked))
    return _stream(marked, _plans(sequences, grammar(sequences)))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """Messages of the repaired conversations: conversation, place from 0, role, text and the edit that made it.

    ``copies`` says how often a row stands, one after the other (0: it is gone,
    but its conversation is known).  The row behind a conversation's messages
    has no place, and its report.  Other columns are not looked at.
    """
    kind = rows.schema[conv].dataType.simpleString()
    schema = f"{conv} {kind}, place long, role string, text string, edit string, {COUNTS}, cost long, audit string"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _applied(batches):
            yield _batch(arrow, [(*row[:5], *(_report(row[5]) if row[5] else [None] * 7)) for row in out])

    return _prepared(rows, conv, turn, role, text, copies).mapInArrow(run, schema)


def _report(told: tuple[dict, str]) -> tuple:
    report, audit = told
    return (*(report[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), audit)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of conversations with one of five faults, by a checksum of their key, and how often each stands then."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    return rows, F.col("copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of each conversation after damage and repair."""
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {COUNTS}, cost long, audit string, repaired_sha256 string"
    arrow = _arrow_schema(spark, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first, out = sha256(), True, []
        for messages in _applied(batches):
            for conv, place, role, text, _, told in messages:
                if place is not None:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                else:
                    out.append((conv, *_report(told), digest.hexdigest()))
                    digest, first = sha256(), True
            if len(out) > 4096:
                yield _batch(arrow, out)
                out = []
        if out:
            yield _batch(arrow, out)

    return _prepared(rows, "conv_id", "turn", "role", "text", copies).mapInArrow(digests, schema)


def oracle_sql() -> str:
    """The query in SQL: edits message by message over the four states, without grammar and chunks."""
    far = 1 << 40
    state = "list_value({0})"
    add = lambda s, cost, letter: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    least = lambda *options: f"list_min([{', '.join(options)}])"
    # insertions: into the state behind a user, then behind an assistant
    t2 = least("s[3]", *(add(f"s[{k}]", INSERT, "I") for k in (1, 2, 4)))
    inserted = f"list_transform([{{'x': {t2}}}], lambda v: [s[1], s[2], v.x, {least('s[4]', add('v.x', INSERT, 'I'))}])[1]"
    # a message m: role, whether it must go, whether it is cut
    gone = [add(f"e[{k}]", DELETE, "D") for k in (1, 2, 3, 4)]
    taken = lambda k, role: f"CASE WHEN m[2].c = 1 THEN {{'c': {far}, 'a': ''}} ELSE {{'c': e[{k}].c + m[3].c + CASE WHEN m[1].a = '{role}' THEN {KEEP} ELSE {REROLE} END, 'a': e[{k}].a || CASE WHEN m[1].a = '{role}' THEN 'K' ELSE 'R' END}} END"
    system = f"CASE WHEN m[2].c = 0 AND m[1].a = 's' THEN {{'c': e[1].c + m[3].c, 'a': e[1].a || 'K'}} ELSE {{'c': {far}, 'a': ''}} END"
    edited = f"[{gone[0]}, {least(gone[1], system)}, {least(gone[2], taken(1, 'u'), taken(2, 'u'), taken(4, 'u'))}, {least(gone[3], taken(3, 'a'))}]"
    step = f"list_transform([{inserted}], lambda e: {edited})[1]"
    start = state.format(f"{{'c': 0::BIGINT, 'a': ''}}, {{'c': {far}::BIGINT, 'a': ''}}, {{'c': {far}::BIGINT, 'a': ''}}, {{'c': {far}::BIGINT, 'a': ''}}")
    row = "rows[CAST(a.k AS INTEGER) + 1]"
    new = "CASE WHEN a.p = 'u' THEN 'assistant' ELSE 'user' END"
    put = lambda k, role, text: f"{{'k': a.k + {k}, 'p': left({role}, 1), 'o': a.o || CASE WHEN a.o = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}}}"
    apply = f"CASE l.p WHEN 'D' THEN {{'k': a.k + 1, 'p': a.p, 'o': a.o}} WHEN 'I' THEN {put(0, new, chr(39) * 2)} WHEN 'K' THEN {put(1, row + '.role', row + '.text')} ELSE {put(1, new, row + '.text')} END"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH t AS ({SQL_CRC_TABLE}),
  src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations, t),
  dam AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
  sorted AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place, trim(text, {space}) AS body FROM dam),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM sorted),
  judged AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM placed),
  conv AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'role': role, 'text': text}} ORDER BY place) AS rows, list([{{'c': 0::BIGINT, 'a': left(role, 1)}}, {{'c': CASE WHEN fault IN (1, 2) THEN 1::BIGINT ELSE 0::BIGINT END, 'a': ''}}, {{'c': CASE WHEN fault = 3 THEN {CUT}::BIGINT ELSE 0::BIGINT END, 'a': ''}}] ORDER BY place) AS symbols FROM judged GROUP BY conv_id),
  done AS (SELECT *, list_reduce(symbols, lambda s, m: {step}, {start}) AS s FROM conv), last AS (SELECT * EXCLUDE s, {inserted} AS s FROM done), best AS (SELECT * EXCLUDE s, list_min([s[1], s[4]]) AS b FROM last),
  fixed AS (SELECT *, list_reduce(list_transform(string_split(b.a, ''), lambda x: {{'k': 0::BIGINT, 'p': x, 'o': ''}}), lambda a, l: {apply}, {{'k': 0::BIGINT, 'p': '', 'o': ''}}) AS f FROM best)
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(f.o, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN fixed ON c.conv_id IS NOT DISTINCT FROM fixed.conv_id"""
