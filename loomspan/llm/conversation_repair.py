"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(system? (user assistant)+)?``.

The dynamic programme has four states: nothing yet, after a system row, after a user row, after an assistant row. A row acts on them as a
4 x 4 min-plus matrix that depends only on its symbol, its role and its fault. Equal consecutive symbols are collapsed to a run, and a
run advances the costs through the matrix's powers of two, which are cached for all conversations. The choices are unrolled from
the costs at the ends of the runs: a run is halved by the same powers until single rows are left, so what a conversation
holds is its runs, and its audit, not a table of costs by row.

Spark deals conversations by hash and sorts their rows; one stream of narrow rows (roles, digests, flags) makes the audits, a second
one joins them to the texts, which move once. A conversation's texts are only hashed or told row by row, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, stored

_FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row leads from each state, by the initial of its role.
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where an inserted or re-roled row leads: the only role that may follow.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT = 2, 3, 2
#: What insertions up to the end cost from each state.
_FINISH = (0, 2 * INSERT, INSERT, 0)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACES = " \t\n\x0b\x0c\r"


def _times(m: tuple, costs: tuple) -> tuple:
    """Costs to go before the rows that ``m`` stands for, from those after them."""
    return tuple(min(x + c for x, c in zip(row, costs, strict=True)) for row in m)


def _product(a: tuple, b: tuple) -> tuple:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(x + y for x, y in zip(row, col, strict=True)) for col in columns) for row in a)


def _row_matrix(symbol: tuple[str, int]) -> tuple:
    """Least cost from state to state over one row and the insertions before it."""
    initial, fault = symbol
    taken = []
    for state in range(4):
        row = [_FAR] * 4
        row[state] = DELETE
        if fault not in (BLANK, DUPLICATE):
            extra = fault == TRUNCATED
            row[_NEXT[state]] = min(row[_NEXT[state]], REROLE + extra)
            if state in (keep := _KEEP.get(initial, {})):
                row[keep[state]] = min(row[keep[state]], int(extra))
        taken.append(row)
    inserted = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        at, cost = state, 0
        while cost < inserted[state][at]:
            inserted[state][at] = cost
            at, cost = _NEXT[at], cost + INSERT
    return _product(tuple(map(tuple, inserted)), tuple(map(tuple, taken)))


class Powers:
    """Min-plus powers 1, 2, 4, ... of each symbol's matrix, made when first asked for."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, int], list[tuple]] = {}

    def of(self, symbol: tuple[str, int], bit: int) -> tuple:
        powers = self.held.setdefault(symbol, [])
        while len(powers) <= bit:
            powers.append(_product(powers[-1], powers[-1]) if powers else _row_matrix(symbol))
        return powers[bit]

    def before(self, symbol: tuple[str, int], length: int, costs: tuple) -> tuple:
        """Costs to go before ``length`` equal rows."""
        bit = 0
        while length >> bit:
            if length >> bit & 1:
                costs = _times(self.of(symbol, bit), costs)
            bit += 1
        return costs


def _row_edits(symbol: tuple[str, int], state: int, costs: tuple, after: tuple) -> tuple[str, int]:
    """The ASCII-least edits up to and with one row that cost no more than need be, and the state after it."""
    initial, fault = symbol
    edits, must, extra = "", fault in (BLANK, DUPLICATE), fault == TRUNCATED
    while True:
        if DELETE + after[state] == costs[state]:
            return f"{edits}D", state
        if INSERT + costs[_NEXT[state]] == costs[state]:
            edits, state = f"{edits}I", _NEXT[state]
            continue
        kept = None if must else _KEEP.get(initial, {}).get(state)
        if kept is not None and extra + after[kept] == costs[state]:
            return f"{edits}K", kept
        return f"{edits}R", _NEXT[state]


def cheapest_edits(runs: list[tuple[tuple[str, int], int]], powers: Powers) -> tuple[int, str]:
    """Cost and audit of a conversation given as runs of (initial of the role, fault) and their lengths."""
    ends = [_FINISH]
    for symbol, length in reversed(runs):
        ends.append(powers.before(symbol, length, ends[-1]))
    cost, state, audit = ends[-1][START], START, []
    for k, (symbol, length) in enumerate(runs):
        waiting = [(length, ends[-2 - k])]  # pieces of the run, the next one last, with the costs after them
        while waiting:
            rows, after = waiting.pop()
            if rows > 1:
                bit = (rows - 1).bit_length() - 1
                waiting += [(1 << bit, after), (rows - (1 << bit), _times(powers.of(symbol, bit), after))]
            else:
                edits, state = _row_edits(symbol, state, _times(powers.of(symbol, 0), after), after)
                audit.append(edits)
    while state not in (START, ASSISTANT):
        audit.append("I")
        state = _NEXT[state]
    return cost, "".join(audit)


def repaired(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The roles and texts that the edits of ``audit`` make of ``rows``."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _KEEP[role[:1]][state]
        else:
            state = _NEXT[state]
            role = _ROLE[state]
        yield role, text


class _Conversation:
    """What is held of the conversation that streams by."""

    def __init__(self) -> None:
        self.runs: list[list] = []
        self.counts, self.illegal, self.turns, self.low, self.high = [0, 0, 0, 0], 0, 0, None, None
        self.last: tuple | None = None

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, later: bool, ended: bool) -> None:
        """``later``: this role and text have been in an earlier turn."""
        here = (turn, role, digest)
        fault = BLANK if blank else DUPLICATE if later or here == self.last else 0 if ended else TRUNCATED
        self.counts[fault] += 1
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = here
        symbol = (role[:1] if role[:1] in ("s", "u", "a") and fault in (0, TRUNCATED) else "", fault)
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` with a fault for each row that falls on one by the CRC of its id and turn, and ``times`` it occurs.

    Of 20 rows one is dropped (``times`` 0), one emptied, one loses its ``.!?``, one is there twice, one becomes a user's.
    """
    spelled = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv", "turn"))
    dice = F.crc32(F.concat_ws(":", *spelled).cast("binary")) % 20
    text = F.when(dice == 1, F.lit("")).when(dice == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role, times = F.when(dice == 4, F.lit("user")).otherwise(F.col("role")), F.when(dice == 0, 0).when(dice == 3, 2).otherwise(1)
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def conversation_rows(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, text, times``: null roles and texts are one space, every row occurs once."""
    words = (F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(y) for x, y in ((role_col, "role"), (text_col, "text")))
    return table.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *words, F.lit(1).alias("times"))


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """One row per conversation: the counts of ``_STATS`` and the audit."""
    kind = rows.schema["conv"].dataType.simpleString()
    trimmed: Column = F.rtrim("text", F.lit(_SPACES))
    narrow = rows.select("conv", "turn", "role", "times", F.unhex(F.sha2("text", 256)).alias("digest"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"))
    narrow = tmp.keep(narrow, "narrow")
    # The earliest turn of each role and text, null before all others: one row per text, however often it occurs.
    order = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("at"))
    firsts = narrow.filter("times > 0").groupBy("conv", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    name = F.struct("conv", "role", "digest")  # one value, so that null ids meet each other
    firsts = firsts.select(F.xxhash64(name).alias("key"), name.alias("name"), "first")
    marked = narrow.withColumn("hash", F.xxhash64(name)).join(firsts, (F.col("hash") == F.col("key")) & name.eqNullSafe(F.col("name")), "left")
    later = F.col("first").isNotNull() & ~order.eqNullSafe(F.col("first"))
    marked = marked.select(narrow["conv"], narrow["turn"], narrow["role"], "times", narrow["digest"], "blank", later.alias("later"), "ended")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, out, now, held = Powers(), [], None, None

        def close() -> None:
            cost, audit = cheapest_edits(held.runs, powers)
            out.append((now, held.gaps(), *held.counts[1:], held.illegal, cost, audit))

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * (len(_STATS) + 2)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["conv", *_STATS, "audit"])

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * len(_STATS), pa.string()]
            size = 0
            for conv, turn, role, times, digest, blank, later, ended in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv != now:
                    if held is not None:
                        close()
                        size += len(out[-1][-1])
                        if size > 1 << 24:
                            yield told()
                            out, size = [], 0
                    now, held = conv, _Conversation()
                for _ in range(times):
                    held.add(turn, role, digest, blank, later, ended)
            yield told()
            out = []
        if held is not None:
            close()
            yield told()

    dealt = marked.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.mapInArrow(run, f"conv {kind}, {', '.join(f'{x} long' for x in _STATS)}, audit string")


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its rows in order: ``conv, turn, role, text, times, head`` and the audit's columns."""
    empty = [F.lit(None).cast("long").alias(x) for x in _STATS]
    head = audits.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("times"), F.lit(True).alias("head"), *_STATS, F.lit(None).cast("binary").alias("digest"))
    body = rows.filter("times > 0").select("conv", "turn", "role", "text", "times", F.lit(False).alias("head"), *empty, F.unhex(F.sha2("text", 256)).alias("digest"))
    both = head.unionByName(body).repartition("conv")
    return both.sortWithinPartitions("conv", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "digest").drop("digest")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, Iterable[tuple[str, str]]]]:
    """The heads of conversations (key, counts, audit), each with an iterator over its rows, as they stream by."""
    rows = ((row, times) for batch in batches for part in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(part, 256).columns), strict=True) for times in [row[4]])
    waiting = next(rows, None)
    while waiting is not None:
        head = waiting[0]

        def body() -> Iterator[tuple[str, str]]:
            nonlocal waiting
            waiting = next(rows, None)
            while waiting is not None and not waiting[0][5]:
                for _ in range(waiting[1]):
                    yield waiting[0][2], waiting[0][3]
                waiting = next(rows, None)

        own = body()
        yield head, own
        for _ in own:  # what the reader left
            pass


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation ``conv``, its counts, cost, audit and ``repaired_sha256``, of rows ``conv, turn, role, text, times``.

    Rows count as often as ``times`` says; a conversation of which all rows have ``times`` 0 has zeros, an empty audit and the hash
    of nothing. Rows of one turn are taken by role, then by the SHA-256 of the text; a null turn comes first. A null ``conv`` is a
    conversation of its own. Role and text must not be null (:func:`conversation_rows` sees to that); empty ones are as they are, and an
    empty or other role than system, user or assistant can only be re-roled or deleted. A very long text is in memory alone with
    its Arrow batch; a very long conversation holds its runs and its audit, which is one value of the result anyway. Its texts
    are hashed as one stream, since SHA-256 goes from first to last. An empty table gives no rows.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        conv_type, out = first.schema.field(0).type, []

        def told() -> pa.RecordBatch:
            kinds = [conv_type, *[pa.int64()] * len(_STATS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", *_STATS, "audit", "repaired_sha256"])

        size = 0
        for head, body in _pieces(b for group in ([first], batches) for b in group):
            digest, between = hashlib.sha256(), b""
            for role, text in repaired(body, head[3]):
                digest.update(between + role.encode("utf-8", "surrogatepass") + b":")
                digest.update(text.encode("utf-8", "surrogatepass"))
                between = b"\n"
            out.append((head[0], *head[6:], head[3], digest.hexdigest()))
            size += 100 + len(head[3])
            if size > 1 << 22:
                yield told()
                out, size = [], 0
        if out:
            yield told()

    with Scratch(rows.sparkSession, "repair") as tmp:
        audits = tmp.keep(_audits(rows, tmp), "audits")
        return stored(_streamed(rows, audits).mapInArrow(run, f"conv {kind}, {', '.join(f'{x} long' for x in _STATS)}, audit string, repaired_sha256 string"), "conversation-repair")


def repair(table: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations themselves: ``conv, place, role, text``, places counted from 0; cases as in :func:`repair_report`.

    Null roles and texts count as one space (so such a text is blank, and its row goes). A conversation of which nothing is left has no rows.
    """
    rows = conversation_rows(table, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds, out, size = [first.schema.field(0).type, pa.int64(), pa.string(), pa.string()], [], 0
        for head, body in _pieces(b for group in ([first], batches) for b in group):
            for place, (role, text) in enumerate(repaired(body, head[3])):
                out.append((head[0], place, role, text))
                size += 32 + len(text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "place", "role", "text"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "place", "role", "text"])

    with Scratch(table.sparkSession, "repair") as tmp:
        audits = tmp.keep(_audits(rows, tmp), "audits")
        return stored(_streamed(rows, audits).mapInArrow(run, f"conv {kind}, place long, role string, text string"), "conversation-repaired")
