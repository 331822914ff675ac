"""Typed filter clauses over sessions, days, calls, events and skills, compiled to columns and semi joins.

Clauses are built in Python (there is no query text to parse)::

    Filters(clause("tool", "is", "error"), clause("weekday", "is", "mo"), ~clause("cost", ">", "2"))

Unknown values (null) never satisfy a comparison, so ``~clause("cost", ">", 2)`` does match an unknown cost. On an attribute
with several values a positive operator asks for any value and a negative one for none. Call clauses of one filter must all
hold on one call; day clauses on one day, and a call must lie on such a day.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import families
from loomspan.functions import scalars as S

NUMERIC = ("usd", "tok", "num", "ratio", "dur", "size")
COMPARE = (">", ">=", "<", "<=")
INVERSE = {"is": "is_not", "is_not": "is", "is_one_of": "is_not_one_of", "is_not_one_of": "is_one_of", "~": "!~", "!~": "~"}


@dataclass(frozen=True)
class Attribute:
    """One key of the catalogue: its entity, type and the column it reads; ``many`` if that column is an array."""

    key: str
    entity: str
    kind: str
    value: Callable[[], Column]
    many: bool = False
    only: tuple[str, ...] = ()

    def operators(self) -> tuple[str, ...]:
        if self.only:
            return self.only
        if self.kind in NUMERIC or self.kind == "date":
            return ("is", "is_not", *COMPARE)
        if self.kind == "bool":
            return ("is", "is_not")
        return ("is", "is_not", "is_one_of", "is_not_one_of", "~", "!~")


CATALOGUE: dict[str, Attribute] = {}


def register(key: str, entity: str, kind: str, value: str | Callable[[], Column] | None = None, **more) -> Attribute:
    """Add an attribute (the extension point): ``value`` is a column name or builds the column."""
    name = value or key
    CATALOGUE[key] = made = Attribute(key, entity, kind, (lambda: F.col(name)) if isinstance(name, str) else name, **more)
    return made


for _key, _kind, _col in (
    ("harness", "enum", "harness"), ("repo", "text", "repo"), ("project", "text", "repo"), ("cwd", "path", "cwd"), ("branch", "text", "branch"),
    ("title", "text", "title"), ("id", "text", "session"), ("agent", "text", "agent"), ("live", "bool", "live"), ("archived", "bool", "archived"), ("host", "enum", "host"),
    ("state", "enum", "state"), ("cost", "usd", "cost"), ("tokens", "tok", "tokens"), ("tokens.in", "tok", "input"), ("tokens.out", "tok", "output"),
    ("tokens.cache_read", "tok", "cache_read"), ("tokens.cache_write", "tok", "cache_write"), ("tools", "num", "tools"), ("errors", "num", "errors"), ("lines.added", "num", "lines_added"),
    ("lines.removed", "num", "lines_removed"), ("error_rate", "ratio", "error_rate"), ("age", "dur", "age_ms"), ("worktree", "path", "worktree"), ("mux", "text", "mux"),
    ("workspace", "text", "workspace"), ("member", "text", "member"), ("room", "text", "room"),
):
    register(_key, "session", _kind, _col)
register("subagent", "session", "bool", lambda: F.col("parent").isNotNull())
register("lines", "session", "num", lambda: F.col("lines_added") + F.col("lines_removed"))
register("content", "session", "text", "content", only=("~", "!~"))
for _key, _kind, _col in (("day", "date", "day"), ("day.cost", "usd", "day_cost"), ("day.tokens", "tok", "day_tokens"), ("day.tools", "num", "day_tools")):
    register(_key, "day", _kind, _col)
register("weekday", "day", "enum", lambda: S.weekday_name(F.dayofweek("day") - 1))
for _key, _kind, _col, _many in (
    ("tool", "text", "tool", False), ("model", "text", "model", False), ("program", "text", "programs", True), ("command", "text", "commands", True), ("family", "text", "family", False),
    ("file", "path", "files", True), ("duration", "dur", "ms", False), ("out", "size", "out", False), ("hour", "num", "hour", False),
):
    register(_key, "call", _kind, _col, many=_many)
register("server", "call", "text", lambda: S.mcp_server(F.col("tool")))
register("kind", "call", "enum", lambda: S.tool_category(F.col("tool")))
register("ext", "call", "text", lambda: F.transform("files", S.extension), many=True)
register("status", "call", "enum", lambda: F.when(F.col("err").isNull(), "unknown").when(F.col("err"), "error").otherwise("ok"))
register("event.kind", "event", "enum", lambda: F.array_union("kinds", F.transform("kinds", lambda k: F.substring_index(k, ":", 1))), many=True)  # a family means all its kinds
register("event", "event", "enum", "raw")
register("mcp.server", "event", "text", lambda: S.mcp_server(F.col("tool")))
register("shell.family", "event", "text", "family")
for _key, _kind, _col, _many in (
    ("skill", "text", "skill", False), ("skill.trigger", "enum", "triggers", True), ("skill.loads", "num", "loads", False), ("skill.cost", "usd", "cost", False), ("skill.carry", "usd", "carry", False),
    ("skill.tail", "usd", "tail", False), ("skill.size", "tok", "size", False), ("skill.scope", "enum", "scope", False),
):
    register(_key, "skill", _kind, _col, many=_many)

_UNITS = {
    "dur": {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000},
    "tok": {"k": 1e3, "m": 1e6},
    "size": {"b": 1, "k": 1024, "kb": 1024, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30},
}


def number(kind: str, value: str | float) -> float:
    """A literal in its type's base unit: dollars, tokens, bytes, ms, or a ratio of 0 to 1."""
    m = re.fullmatch(r"\$?(-?\d+(?:\.\d+)?)([a-zA-Z%]*)", str(value).strip())
    if not m:
        raise ValueError(f"{value!r} is no {kind}")
    n, unit = float(m[1]), m[2].lower()
    if unit == "%" and kind == "ratio":
        return n / 100
    if not unit:
        if kind == "ratio" and n > 1:
            raise ValueError(f"{value!r}: a ratio is 0 to 1, or has a %")
        if kind == "dur":
            raise ValueError(f"{value!r}: a duration has a unit")
        return n
    try:
        return n * _UNITS[kind][unit]
    except KeyError:
        raise ValueError(f"{value!r} has no unit of a {kind}") from None


def day_of(value: str, today: date) -> str:
    """today, yesterday, -Nd or YYYY-MM-DD as a day."""
    low = value.lower()
    back = 0 if low == "today" else 1 if low == "yesterday" else int(low[1:-1]) if re.fullmatch(r"-\d+d", low) else None
    return low if back is None else (today - timedelta(days=back)).isoformat()


@dataclass(frozen=True)
class Clause:
    key: str
    op: str
    values: tuple[str, ...]
    negated: bool = False

    @property
    def attribute(self) -> Attribute:
        return CATALOGUE[self.key]

    def __invert__(self) -> Clause:
        """Negation: the inverse operator where there is one, else a negated comparison."""
        if self.op in INVERSE:
            return replace(self, op=INVERSE[self.op])
        return replace(self, negated=not self.negated)

    def column(self, today: date | None = None) -> Column:
        """A predicate that is never null."""
        a, op = self.attribute, self.op
        value = a.value()
        if self.values == ("unknown",) and op in ("is", "is_not") and a.kind != "enum":
            missing = F.size(value) == 0 if a.many else value.isNull()
            return F.coalesce(missing, F.lit(True)) == F.lit(op == "is")
        if a.kind in NUMERIC:
            x = number(a.kind, self.values[0])
            tests = {">": value > x, ">=": value >= x, "<": value < x, "<=": value <= x, "is": F.abs(value - x) < 1e-9, "is_not": F.abs(value - x) >= 1e-9}
            found = F.coalesce(tests[op], F.lit(False))
            return ~found if self.negated else found
        if a.kind == "date":
            x = F.lit(day_of(self.values[0], today or date.today())).cast("date")
            tests = {">": value > x, ">=": value >= x, "<": value < x, "<=": value <= x, "is": value == x, "is_not": value != x}
            found = F.coalesce(tests[op], F.lit(False))
            return ~found if self.negated else found
        if a.kind == "bool":
            found = F.coalesce(value, F.lit(False)) == F.lit(self.values[0].lower() in ("true", "yes"))
            return found if op == "is" else ~found
        words = [v.lower() for v in self.values]

        def one(s: Column) -> Column:
            low = F.lower(s.cast("string"))
            if op in ("~", "!~"):
                return reduce(Column.__or__, (low.contains(w) for w in words))
            globs = [w for w in words if a.kind == "path" and "*" in w]
            plain = [w for w in words if w not in globs]
            tests = [low.rlike(glob_pattern(g)) for g in globs] + ([low.isin(plain)] if plain else [])
            return reduce(Column.__or__, tests)

        found = F.exists(value, lambda s: F.coalesce(one(s), F.lit(False))) if a.many else one(value)
        found = F.coalesce(found, F.lit(False))
        return ~found if op in ("is_not", "is_not_one_of", "!~") else found


def glob_pattern(glob: str) -> str:
    """A regular expression for ``*`` (in one segment), ``**`` (across) and ``?``; without a slash the basename is matched."""
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]+", glob))
    return f"^{body}$" if "/" in glob else f"(?:^|/){body}$"


def clause(key: str, op: str, *values: str | float) -> Clause:
    """A checked clause: the key exists, the operator fits its type, values parse."""
    if key not in CATALOGUE:
        near = suggest(key)
        raise ValueError(f"no attribute {key!r}" + (f"; did you mean {near!r}?" if near else ""))
    a = CATALOGUE[key]
    if op not in a.operators():
        raise ValueError(f"{key} takes {', '.join(a.operators())}; not {op}")
    made = Clause(key, op, tuple(str(v) for v in values))
    if a.kind in NUMERIC and made.values != ("unknown",):
        number(a.kind, made.values[0])
    return made


def suggest(word: str, most: int = 2) -> str | None:
    """The nearest key within an edit distance of ``most``."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    best = min(CATALOGUE, key=lambda k: (distance(word, k), k))
    return best if distance(word, best) <= most else None


@dataclass(frozen=True)
class Filters:
    """A conjunction of clauses."""

    clauses: tuple[Clause, ...] = field(default=())

    def __init__(self, *clauses: Clause):
        object.__setattr__(self, "clauses", tuple(clauses))

    # Algebra of saved and pinned filters.

    def add(self, new: Clause) -> Filters:
        """With ``new`` unless it is there already; a positive set of the same key narrows to what both allow."""
        same = [c for c in self.clauses if c.key == new.key and c.op in ("is", "is_one_of") and new.op in ("is", "is_one_of") and not c.attribute.many]
        if new in self.clauses:
            return self
        if same:
            both = tuple(v for v in same[0].values if v in new.values)
            if both:
                return Filters(*(replace(c, op="is" if len(both) == 1 else "is_one_of", values=both) if c == same[0] else c for c in self.clauses))
        return Filters(*self.clauses, new)

    def include(self, new: Clause) -> Filters:
        """Widen a positive set of the same key by the new values, else add."""
        for c in self.clauses:
            if c.key == new.key and c.op in ("is", "is_one_of") and new.op in ("is", "is_one_of"):
                values = tuple(dict.fromkeys((*c.values, *new.values)))
                return Filters(*(replace(x, op="is" if len(values) == 1 else "is_one_of", values=values) if x == c else x for x in self.clauses))
        return self.add(new)

    def effective(self, local: Filters) -> Filters:
        """Pinned clauses under a local override: a local clause replaces the pinned ones of its key."""
        keys = {c.key for c in local.clauses}
        return Filters(*(c for c in self.clauses if c.key not in keys), *local.clauses)

    def of(self, entity: str) -> list[Clause]:
        return [c for c in self.clauses if c.attribute.entity == entity]

    def column(self, entity: str, today: date | None = None) -> Column:
        """All clauses of an entity as one predicate."""
        return reduce(Column.__and__, (c.column(today) for c in self.of(entity)), F.lit(True))

    def __str__(self) -> str:
        """Canonical form, for display and as a cache key."""
        return " and ".join(("not " if c.negated else "") + f"{c.key} {c.op} {', '.join(c.values)}" for c in self.clauses)

    def check(self, allowed: tuple[str, ...]) -> Filters:
        """Refuse clauses on entities that a view does not have."""
        for c in self.clauses:
            if c.attribute.entity not in allowed:
                raise ValueError(f"{c.key} is about a {c.attribute.entity}; this view has {', '.join(allowed)}")
        return self


def matching_calls(calls: DataFrame, filters: Filters, days: DataFrame | None = None, today: date | None = None, retention_days: int | None = None) -> DataFrame:
    """Calls on which all call clauses hold at once, on a day on which all day clauses hold.

    Day clauses on the day's date only need no join; others need ``days`` (session, day and its sums).
    """
    found = calls.filter(filters.column("call", today))
    if retention_days is not None:
        found = found.filter(F.col("day") > F.lit((today or date.today()) - timedelta(days=retention_days)))
    on_date = Filters(*(c for c in filters.of("day") if c.key in ("day", "weekday")))
    found = found.filter(on_date.column("day", today))
    if len(on_date.clauses) < len(filters.of("day")):
        found = found.join(days.filter(filters.column("day", today)).select("session", "day"), ["session", "day"], "left_semi")
    return found


def matching_sessions(
    sessions: DataFrame,
    filters: Filters,
    calls: DataFrame | None = None,
    days: DataFrame | None = None,
    events: DataFrame | None = None,
    skills: DataFrame | None = None,
    today: date | None = None,
) -> DataFrame:
    """Sessions that satisfy the filter; clauses on other entities are lifted by semi joins on matching rows."""
    found = sessions.filter(filters.column("session", today))
    if filters.of("call"):
        found = found.join(matching_calls(calls, filters, days, today).select("session"), "session", "left_semi")
    elif filters.of("day"):
        found = found.join(days.filter(filters.column("day", today)).select("session"), "session", "left_semi")
    if filters.of("event"):
        found = found.join(events.filter(filters.column("event", today)).select("session"), "session", "left_semi")
    if filters.of("skill"):
        found = found.join(skills.filter(filters.column("skill", today)).select("session"), "session", "left_semi")
    return found


def event_rows(calls: DataFrame, turns: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Events that event clauses are lifted from: session, raw, kinds, tool, family. Calls, and if given turns and marks.

    ``calls``: session, tool, argument, err; ``turns``: session, role (user: prompt, assistant: reply, else meta); ``marks``: session, kinds.
    """
    shell = F.when(S.tool_category(F.col("tool")) == "shell", families.call_family(F.col("argument"))["family"])
    rows = calls.select("session", F.lit("tool").alias("raw"), families.event_kinds(F.col("tool"), F.col("argument"), F.col("err")).alias("kinds"), "tool", shell.alias("family"))
    if turns is not None:
        role = F.col("role")
        raw = F.when(role.isin("user", "assistant"), role).otherwise("meta")
        told = F.when(role == "user", "prompt").when(role == "assistant", "reply").otherwise("meta")
        rows = rows.unionByName(turns.select("session", raw.alias("raw"), F.array(told).alias("kinds")), allowMissingColumns=True)
    if marks is not None:
        rows = rows.unionByName(marks.select("session", F.lit("meta").alias("raw"), "kinds"), allowMissingColumns=True)
    return rows


def having_text(sessions: DataFrame, turns: DataFrame, words: str) -> DataFrame:
    """Sessions with a turn whose text has ``words``, in any case."""
    return sessions.join(turns.filter(F.lower("text").contains(words.lower())).select("session"), "session", "left_semi")


def session_and_children(sessions: DataFrame, ref) -> DataFrame:
    """A session and those it spawned."""
    return sessions.filter((F.col("session") == ref) | (F.col("parent") == ref))


def resolve_prefix(sessions: DataFrame, prefix: str, least: int = 6) -> DataFrame:
    """Sessions whose id is ``prefix`` or, from ``least`` characters on, starts with it; several rows mean it is ambiguous."""
    ids = F.col("session").cast("string")
    return sessions.filter((ids == prefix) | (F.lit(len(prefix) >= least) & ids.startswith(prefix)))
