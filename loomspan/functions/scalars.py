"""Scalar functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges in ms of the 16 duration buckets, and the middles used for quantiles.
EDGES = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 180000, 600000, 1800000)
MIDDLES = (5, 16, 35, 71, 158, 354, 707, 1581, 3536, 7071, 17321, 42426, 103923, 328634, 1039230)
WEEKDAYS = ("su", "mo", "tu", "we", "th", "fr", "sa")


def bucket(ms: Column) -> Column:
    """Number of the duration bucket: how many edges are at or below ``ms``; null for null."""
    return sum(((ms >= e).cast("int") for e in EDGES[1:]), (ms >= EDGES[0]).cast("int"))


def _short(ms: int) -> str:
    return f"{ms}ms" if ms < 1000 else f"{ms // 1000 if ms % 1000 == 0 else ms / 1000}s" if ms < 60000 else f"{ms // 60000}m"


DURATION_LABELS = ("<10ms", *(f"≥{_short(e)}" for e in EDGES))


def duration_label(ms: Column) -> Column:
    return F.when(ms.isNull(), F.lit("unknown")).otherwise(F.element_at(F.array(*map(F.lit, DURATION_LABELS)), bucket(ms) + 1))


def output_label(size: Column) -> Column:
    """Steps of 16 from 1 KB to 1 GB."""
    steps = [("<1KB", 1024), ("≥1KB", 1024 * 16), ("≥16KB", 1024 * 256), ("≥256KB", 1024 * 4096), ("≥4MB", 1024 * 65536), ("≥64MB", 1024 * 1048576)]
    label = reduce(lambda c, s: c.when(size < s[1], s[0]), steps, F.when(size.isNull(), "unknown"))
    return label.otherwise("≥1024MB")


def weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), number + 1)


def histogram_quantile(hist: Column, q: float, top: Column) -> Column:
    """The q-quantile of a bucket histogram: the middle of its bucket, never above the real maximum; null without values."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = F.transform(F.sequence(F.lit(1), F.lit(len(EDGES) + 1)), lambda i: F.aggregate(F.slice(hist, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    place = F.array_position(F.transform(sums, lambda s: s >= q * total), True).cast("int")
    middle = F.when(place > len(EDGES), top).otherwise(F.least(top, F.element_at(F.array(*(F.lit(m).cast("long") for m in MIDDLES)), F.least(place, F.lit(len(EDGES))))))
    return F.when(total > 0, middle)


def histogram_of(ms: Column) -> Column:
    """Aggregate: the histogram of durations."""
    return histogram(bucket(ms))


def histogram(b: Column) -> Column:
    """Aggregate of bucket numbers: counts in the 16 buckets; 16 conditional counts that Spark pre-aggregates."""
    return F.array(*(F.count_if(b == i) for i in range(len(EDGES) + 1)))


def norm(text: Column) -> Column:
    """Text on one line: white space collapsed, control characters gone, 200 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\x00-\x1f\x7f]", "")), 1, 200)


def mcp_server(tool: Column) -> Column:
    """Server of a tool named ``mcp__server__tool``; empty for others."""
    return F.regexp_extract(tool, r"^mcp__(.+?)__", 1)


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last segment, or empty; a leading dot makes no extension."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/]*$", 0), r"^.+\.([^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def relative(path: Column, top: Column) -> Column:
    """The path below ``top``; paths outside stay whole."""
    return F.when(F.startswith(path, F.concat(top, F.lit("/"))), F.substring(path, F.length(top) + 2, F.length(path))).otherwise(path)


def program(command: Column) -> Column:
    """First real program of a shell line: assignments, wrappers and cd/export segments are passed over."""
    parts = F.transform(F.split(command, r"&&|\|\||;|\||\n"), lambda p: F.trim(p))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|sudo|env|nohup|time|exec|command)\s+)*", ""))
    first = F.transform(bare, lambda p: F.regexp_extract(p, r"^\S+", 0))
    real = F.filter(first, lambda w: (w != "") & ~w.isin("cd", "export", "set", "source", ".", "true", ":"))
    return F.coalesce(F.try_element_at(F.transform(real, basename), F.lit(1)), F.lit(""))


def exit_code(output: Column) -> Column:
    """Exit code that a command's output reports, null if none."""
    return F.nullif(F.regexp_extract(output, r"(?i)exit(?:ed with)?(?: code| status)?[:= ]+(-?\d+)", 1), F.lit("")).cast("int")


def is_error_text(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(?:error|fatal|traceback|exception|failed|command failed)\b|exit code [1-9]")


def commit_shas(output: Column) -> Column:
    """Short commit ids from the banners that git prints on commit, in order."""
    return F.regexp_extract_all(output, F.lit(r"\[[^\[\]\n]*?([0-9a-f]{7,40})\] "), 1)


def forge_links(text: Column) -> Column:
    """Pull-request and issue links."""
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s/]+/[^\s/]+/[^\s/]+/(?:-/)?(?:pull|issues|merge_requests)/\d+"), 0)


def remote_identity(url: Column) -> Column:
    """host/owner/name of a git remote: scheme, user, port and .git dropped, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z+]+://)?(?:[^@/]*@)?", ""), r"(?:\.git)?/*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^([^/:]+):\d+/", "$1/"), r"^([^/:]+):/*", "$1/")


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"://[^@/\s]+@", "://")


def model_id(model: Column) -> Column:
    """List-price key of a model id: provider prefixes, cloud wrappers and date suffixes dropped."""
    last = F.substring_index(F.lower(model), "/", -1)
    bare = F.regexp_replace(last, r"^(?:[a-z]{2,4}\.)?anthropic\.", "")
    cloud = F.when(bare != last, F.regexp_replace(bare, r"-v\d+(?::\d+)?$", "")).otherwise(last)
    return F.regexp_replace(F.regexp_replace(cloud, r"@\d{8}$", ""), r"-\d{8}$", "")


def token_estimate(text: Column, per_token: float = 4.0) -> Column:
    """Tokens of a text by its UTF-8 bytes."""
    return F.ceil(F.octet_length(text) / F.lit(per_token)).cast("long")


def fill(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by its value; unknown names stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), values.items(), template)


def clobber_form(command: Column) -> Column:
    """Form of a git command that can discard others' uncommitted work, or empty: the first such part of a shell line."""
    parts = F.transform(F.split(command, r"&&|\|\||;|\n"), lambda p: F.regexp_replace(F.trim(p), r"^(?:[A-Z_][A-Z0-9_]*=\S*\s+)*", ""))
    subs = F.transform(parts, lambda p: F.regexp_replace(p, r"^git\s+(?:-[Cc]\s+\S+\s+)*", "git "))

    def form(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^git stash(?!\s+(?:list|show)\b)(?:\s|$)"), "git stash")
            .when(p.rlike(r"^git reset\s.*--hard(?:\s|$)|^git reset --hard"), "git reset --hard")
            .when(p.rlike(r"^git clean\s(?:.*\s)?(?:-[a-zA-Z]*f|--force)"), "git clean -f")
            .when(p.rlike(r"^git restore\s(?:.*\s)?\.(?:\s|$)"), "git restore .")
            .when(p.rlike(r"^git (?:checkout|switch)\s(?:.*\s)?\.(?:\s|$)"), F.concat(F.regexp_extract(p, r"^git \w+", 0), F.lit(" .")))
            .when(p.rlike(r"^git (?:checkout|switch)\s(?:.*\s)?(?:-[bBcC]|--orphan)(?:\s|$)"), "")
            .when(p.rlike(r"^git checkout\s+(?:-\S+\s+)*[^-\s./][^\s./]*(?:\s+-(?!-(?:\s|$))\S+)*\s*$"), "git checkout <branch>")
            .when(p.rlike(r"^git switch\s+(?:-\S+\s+)*[^-\s]\S*(?:\s+-(?!-(?:\s|$))\S+)*\s*$"), "git switch <branch>")
            .otherwise("")
        )

    return F.coalesce(F.try_element_at(F.filter(F.transform(subs, form), lambda x: x != ""), F.lit(1)), F.lit(""))


def tool_category(tool: Column) -> Column:
    """shell, edit, read, web, agent, mcp or other, by the tool's name."""
    low = F.lower(tool)
    return (
        F.when(low.rlike("^mcp__"), "mcp")
        .when(low.rlike("bash|shell|exec|terminal|command"), "shell")
        .when(low.rlike("edit|write|patch|replace|create"), "edit")
        .when(low.rlike("read|view|grep|glob|search|list|cat|find"), "read")
        .when(low.rlike("web|fetch|http|browser|url"), "web")
        .when(low.rlike("agent|task|delegate|spawn"), "agent")
        .otherwise("other")
    )


def patch_changes(patch: Column) -> Column:
    """(file, added, removed) of each file of an apply-patch text."""
    bodies = F.filter(F.split(patch, r"(?m)^\*\*\* (?=(?:Add|Update|Delete) File: )"), lambda b: b.rlike(r"^(?:Add|Update|Delete) File: "))
    count = lambda b, sign: F.size(F.filter(F.split(b, "\n"), lambda x: x.startswith(sign))).cast("long")
    return F.transform(bodies, lambda b: F.struct(F.regexp_extract(b, r"^\w+ File: (.*)", 1).alias("file"), count(b, "+").alias("added"), count(b, "-").alias("removed")))


def redact(text: Column) -> Column:
    """Secrets, addresses and home folders masked; same input, same output."""
    steps = (
        (r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*[\"']?)[^\s\"',;]{8,}", "$1***"),
        (r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "user@example.com"),
        (r"\b(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}", "***"),
        (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "0.0.0.0"),
        (r"/(home|Users)/[^/\s]+", "/$1/user"),
    )
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)
