"""Shell lines read as a shell reads them, with built-in functions only: words, segments, families, user rules.

One regular expression cuts a line into tokens: here-documents (dropped with their bodies), separators outside quotes, and words with
their quotes. Words are unquoted piece by piece and kept in one string a segment, parted by :data:`WORD_END`; rules about words are
regular expressions over that string, made from the tables below. What runs in a segment is its first word after assignments,
keywords and wrappers; its family is that program, with the word that tells its task. The first segment that runs something other than a text
filter names the line. A line within ``sh -c`` names its segment, down to :data:`DEPTH` levels; deeper ones are named by the shell.

A null line has a null family. An empty line, or one of trivial steps only, is ``sh``. An unclosed quote or here-document ends with
the line. Quantifiers over groups are possessive, so very long lines need no deep stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Programs by how their family is told.
TRIVIAL = (
    "cd", "pushd", "popd", "export", "source", ".", "set", "unset", "ulimit", "true", "false", "echo", "printf", "test", "[", "[[", "mkdir", "local", "read", "trap", "break", "continue",
    "for", "while", "until", "if", "then", "else", "elif", "do", "done", "fi", "case", "esac", "select", "function", "return", "exit", "shift", "declare", "typeset", "alias", ":",
    "shopt", "setopt", "emulate", "builtin", "hash", "umask", "jobs", "disown",
)
FILTERS = ("cat", "grep", "rg", "sed", "head", "tail", "awk", "jq", "wc", "sort", "uniq", "tee", "less", "cut", "tr", "column")
PACKAGE_MANAGERS = ("npm", "pnpm", "yarn", "bun", "turbo", "nx")
RUNNERS = ("npx", "pnpx", "bunx", "uvx")
WITH_TASK = (
    "poetry", "pipenv", "cargo", "go", "make", "just", "git", "docker", "kubectl", "mvn", "mvnw", "gradle", "gradlew", "dotnet", "terraform", "composer", "mix", "flutter", "deno", "tmux",
    "uv", "pip", "pip3", "bundle", "rake", "helm", "brew", "apt", "apt-get", "dnf", "yum", "next", "vite", "podman", "systemctl",
)
SHELLS = ("sh", "bash", "zsh", "dash", "fish")
INTERPRETERS = ("node", "tsx", "ts-node", "python", "python3", "ruby", "perl", "php", "sh", "bash", "zsh", "dash")
KEYWORDS = ("do", "then", "else", "elif", "while", "until", "if", "!", "time")

# Options that take a word of their own, by program.
WRAPPER_OPTIONS = {
    "sudo": ("-u", "-g", "-C", "-D"), "env": ("-u", "-C", "-S"), "timeout": ("-s", "-k", "--signal", "--kill-after"), "ionice": ("-c", "-n", "-p"), "nice": ("-n",),
    "nohup": (), "time": ("-f", "-o"), "command": (), "exec": (), "caffeinate": (), "stdbuf": ("-i", "-o", "-e"), "rtk": (), "flock": ("-w", "-E", "--timeout", "--conflict-exit-code"),
    "xargs": ("-I", "-n", "-P", "-L", "-d", "-a", "-E", "-s", "--max-args", "--max-procs", "--replace", "--delimiter"),
}
MANAGER_OPTIONS = ("-C", "--dir", "--filter", "-F", "--prefix", "--cwd", "--workspace", "--config")
RUNNER_OPTIONS = ("-p", "--package", "--from", "--with", "--python")
ENVIRONMENT_OPTIONS = (*RUNNER_OPTIONS, "--group", "--extra", "--env-file", "--directory", "--project")
TASK_OPTIONS = {
    "git": ("-C", "-c", "--git-dir", "--work-tree"), "make": ("-C", "-f", "-I", "-l", "--directory", "--file"), "docker": ("-H", "--context", "--host", "-c", "--log-level"),
    "kubectl": ("-n", "--namespace", "--context", "--kubeconfig"), "gh": ("-R", "--repo"), "just": ("-f", "--justfile", "-d", "--working-directory"), "mvn": ("-f", "-pl", "-P", "-s"),
    "gradle": ("-p",), "gradlew": ("-p",), "tmux": ("-L", "-S", "-f"), "uv": ("--directory", "--project"), "cargo": ("-C", "--config"), "pip": ("-r",),
}
INTERPRETER_OPTIONS = ("-r", "--require", "--import", "--loader", "-W", "-X", "-I", "--experimental-loader")

# Kinds of shell lines in their order, and those that count as heavy.
KINDS = ("test", "typecheck", "lint", "build", "install", "ci", "wait", "vcs", "net", "other")
HEAVY = ("test", "typecheck", "lint", "build", "install")

#: Parts words and segments; both are taken out of lines first.
WORD_END, SEGMENT_END = "\x1f", "\x1e"
#: Levels of ``sh -c`` that are looked into.
DEPTH = 3
#: Characters of a family.
LONGEST = 40

_HEREDOC = r"""<<(?!<)-?[ \t]*(?:'([^']+)'|"([^"]+)"|([^\s;&|<>)'"]+))(?:.*?[ \n](?:\1|\2|\3)(?=[ \n;&|)]|\z)|.*+)"""
_SEPARATOR = r"&&|\|\||\|&|;;|[;|\n]|(?<![<>])&(?!>)"
_PIECE = r"""'[^']*+'?|"(?:\\.|[^"\\])*+(?:"|\\?\z)|\\.|\\\z"""
_WORD = rf"""(?:{_PIECE}|<<<|<(?!<)|(?<=[<>])&|&(?=>)|[^\s'"\\<;|&]++)++"""

_U = WORD_END
_NUMBER = rf"\d[\d.]*+[smhd]?(?={_U}|\z)"


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def _options(valued: Sequence[str]) -> str:
    """Options at the start of words, each with the word or number that belongs to it; each match ends with a word's end."""
    own = rf"{_any(valued)}{_U}[^{_U}]++(?:{_U}|\z)|" if valued else ""
    return rf"(?:{own}[-+][^{_U}]*+(?:{_U}{_NUMBER})?(?:{_U}|\z))*+"


def _wrapper(name: str, valued: Sequence[str]) -> str:
    more = {"rtk": rf"(?:(?:proxy|err|summary|test){_U})?+", "flock": rf"(?:[^{_U}]++(?:{_U}|\z))?+" + _options(())}.get(name, "")
    return rf"(?:[^{_U}]*/)?{re.escape(name)}(?:{_U}|\z){_options(valued)}(?:{_NUMBER}(?:{_U}|\z))*+{more}"


_LEAD = rf"(?:[A-Za-z_][A-Za-z0-9_]*+=[^{_U}]*+|{_any(KEYWORDS)}|-[^{_U}]++)(?:{_U}|\z)|" + "|".join(_wrapper(*w) for w in WRAPPER_OPTIONS.items())
_PATH = rf"(?:[^{_U}]*/)?"
_RUN = "|".join(
    (
        rf"{_PATH}{_any(RUNNERS)}{_U}{_options(RUNNER_OPTIONS)}(?=[^{_U}])",
        rf"{_PATH}{_any(PACKAGE_MANAGERS)}{_U}{_options(MANAGER_OPTIONS)}(?:exec|dlx|x){_U}{_options(RUNNER_OPTIONS)}(?=[^{_U}])",
        rf"{_PATH}(?:(?:poetry|pipenv){_U}{_options(())}|uv{_U}{_options(TASK_OPTIONS['uv'])})run{_U}{_options(ENVIRONMENT_OPTIONS)}(?=[^{_U}])",
        rf"{_PATH}bundle{_U}{_options(())}exec{_U}{_options(ENVIRONMENT_OPTIONS)}(?=[^{_U}])",
        rf"{_PATH}python(?:3[\d.]*+)?{_U}-m{_U}(?=[^{_U}])",
        rf"trap{_U}[^{_U}]++{_U}(?:[A-Z0-9]++{_U})*+(?=[^{_U}])(?![A-Z0-9]++\z)",
    )
)
_TO_PROGRAM = rf"^(?:{_LEAD})*+"
_TO_WHAT_RUNS = rf"^(?:{_LEAD}|{_RUN})*+"
_SHELL_LINE = rf"^{_PATH}{_any(SHELLS)}(?:{_U}(?!-[^-{_U}]*c{_U})[-+][^{_U}]*+)*+{_U}-[^-{_U}]*c{_U}([^{_U}]++)"


_TASK_LEAD = "|".join(re.escape(name) + _U + _options(valued) for name, valued in TASK_OPTIONS.items())


def _in(word: Column, words: Sequence[str]) -> Column:
    """Whether it is one of the words; one call to the JVM, where ``isin`` makes one a word."""
    return word.rlike(rf"^{_any(words)}\z")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unquoted(word: Column) -> Column:
    def piece(p: Column) -> Column:
        return (
            F.when(p.startswith("'"), F.regexp_replace(p, "^'|'$", ""))
            .when(p.startswith('"'), F.regexp_replace(F.regexp_replace(p, r'(?s)^"((?:\\.|[^"\\])*+)(?:"|\\?\z)', "$1"), r"(?s)\\(.)", "$1"))
            .when(p.startswith("\\"), F.substring(p, 2, 1))
            .otherwise(p)
        )

    return F.when(~word.rlike(r"""['"\\]"""), word).otherwise(F.array_join(F.transform(F.regexp_extract_all(word, F.lit(rf"""(?s){_PIECE}|[^'"\\]++"""), F.lit(0)), piece), ""))


def segments(line: Column) -> Column:
    """The segments of a line, each as its words parted by :data:`WORD_END`, without redirections and group signs."""
    tokens = F.regexp_extract_all(F.translate(line, WORD_END + SEGMENT_END, ""), F.lit(rf"(?s){_HEREDOC}|{_SEPARATOR}|{_WORD}"), F.lit(0))
    token = lambda t: F.when(t.rlike(r"^<<(?!<)"), "").when(t.rlike(rf"^(?:{_SEPARATOR})\z"), SEGMENT_END).otherwise(_unquoted(t))
    joined = F.array_join(F.filter(F.transform(tokens, token), lambda w: w != ""), WORD_END)

    def plain(s: Column) -> Column:
        s = F.regexp_replace(s, rf"(?:^|(?<={_U}))\d*+(?:[<>]|&>)[^{_U}]*+(?:(?<=[<>]){_U}[^{_U}]++)?", "")
        s = F.regexp_replace(s, rf"(?:^|(?<={_U}))[({{]++|[)}}]++(?={_U}|\z)", "")
        return F.regexp_replace(F.regexp_replace(s, rf"{_U}{{2,}}", WORD_END), rf"^{_U}|{_U}\z", "")

    return F.filter(F.transform(F.split(joined, SEGMENT_END), plain), lambda s: s != "")


def _first_word(words: Column) -> Column:
    return F.substring_index(words, WORD_END, 1)


def _base(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/(?=[^/])", "")


def _what_runs(words: Column, depth: int) -> Column:
    """Family of one segment's words from its program on; empty if it is trivial."""

    def named(w: Column) -> Column:
        raw, unversioned = _first_word(w), F.regexp_extract(_first_word(w), "^(.*)@", 1)
        program = F.when(raw.rlike("^@.*/.*@[^/]*$"), unversioned).when(raw.rlike("^@.*/"), raw).when(raw.rlike("^.+@[^/]*$"), _base(unversioned)).otherwise(_base(raw))
        rest = F.when(F.locate(WORD_END, w) > 0, F.regexp_replace(w, rf"^[^{_U}]*+{_U}", "")).otherwise("")
        return F.struct(w.alias("words"), program.alias("program"), raw.rlike("^.+@[^/]*$|^@.*/").alias("versioned"), rest.alias("rest"))

    return _bound(_bound(words, named), lambda n: _named_family(n["words"], n["program"], n["versioned"], n["rest"], depth))


def _named_family(words: Column, program: Column, versioned: Column, rest: Column, depth: int) -> Column:
    past = lambda w, valued: F.regexp_replace(w, "^" + _options(valued), "")
    is_word = lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9_:.+-]*$")
    with_task = lambda p, w: F.when(is_word(w), F.concat_ws(" ", p, w)).otherwise(p)

    def after(w: Column) -> Column:
        return F.regexp_replace(w, rf"^[^{_U}]*+{_U}?", "")

    def managed(args: Column) -> Column:
        first = _first_word(args)
        return (
            F.when(first == "", F.when(program == "yarn", "yarn install").otherwise(program))
            .when(first.isin("run", "run-script"), with_task(F.concat(program, F.lit(" run")), _first_word(past(after(args), MANAGER_OPTIONS))))
            .when(first.isin("test", "t", "tst"), F.concat(program, F.lit(" test")))
            .when(first.isin("i", "ci", "add", "install"), F.concat(program, F.lit(" install")))
            .otherwise(with_task(program, first))
        )

    def task(args: Column) -> Column:
        first, second = _first_word(args), _first_word(past(after(args), ()))
        two = F.when(is_word(first), F.concat_ws(" ", program, first, F.when(is_word(second), second))).otherwise(program)
        tool = F.when(is_word(_base(second)), F.concat(F.lit("go tool "), _base(second))).otherwise("go tool")
        return F.when(program == "gh", two).when((program == "go") & (first == "tool"), tool).otherwise(with_task(program, first))

    options = F.regexp_replace(F.concat(program, F.lit(WORD_END), rest), rf"^(?:{_TASK_LEAD}|[^{_U}]*+{_U}{_options(())})", "")
    # Options of an interpreter up to its script; ones that carry code, or a lone hyphen, leave no script.
    code = rest.rlike(rf"^(?:{_any(INTERPRETER_OPTIONS)}{_U}[^{_U}]++{_U}|(?!(?:-c|-e|-p|--eval|--print|-)(?:{_U}|\z))-[^{_U}]++{_U})*+(?:-c|-e|-p|--eval|--print|-)(?:{_U}|\z)")
    script = F.regexp_replace(rest, rf"^(?:{_any(INTERPRETER_OPTIONS)}{_U}[^{_U}]++(?:{_U}|\z)|-[^{_U}]++(?:{_U}|\z))*+", "")
    interpreted = F.when(code | (script == ""), program).otherwise(F.concat_ws(" ", program, _base(_first_word(script))))
    if depth < DEPTH:
        inner = _bound(family_of_segments(segments(F.regexp_extract(words, rf"(?s){_SHELL_LINE}", 1)), depth + 1), lambda f: F.when(f.isin("", "sh"), program).otherwise(f))
        interpreted = F.when(_in(program, SHELLS) & words.rlike(rf"(?s){_SHELL_LINE}"), inner).otherwise(interpreted)
    elif depth == DEPTH:
        interpreted = F.when(_in(program, SHELLS) & words.rlike(rf"(?s){_SHELL_LINE}"), program).otherwise(interpreted)
    family = (
        F.when(versioned, program)
        .when((words == "") | (program == "") | _in(program, TRIVIAL), "")
        .when(_in(program, PACKAGE_MANAGERS), _bound(past(rest, MANAGER_OPTIONS), managed))
        .when((program == "gh") | _in(program, WITH_TASK), _bound(options, task))
        .when(_in(program, (*INTERPRETERS, "fish")) | program.rlike(r"^python3\."), interpreted)
        .otherwise(program)
    )
    return F.substring(family, 1, LONGEST)


def _program_words(segment: Column) -> Column:
    return F.regexp_replace(segment, rf"(?s){_TO_PROGRAM}", "")


def segment_family(segment: Column, depth: int = 0) -> Column:
    runs = F.regexp_replace(segment, rf"(?s)^((?:{_LEAD})*+{_PATH}yarn){_U}{_options(MANAGER_OPTIONS)}workspace{_U}[^{_U}]++(?={_U})", "$1")
    runs = F.regexp_replace(runs, rf"(?s){_TO_WHAT_RUNS}", "")
    return _bound(runs, lambda words: _what_runs(words, depth))


def _picked(segments_: Column, depth: int) -> Column:
    """``family, words`` of the segment that names the line, null if all are trivial."""
    named = F.filter(F.transform(segments_, lambda s: F.struct(segment_family(s, depth).alias("family"), s.alias("words"))), lambda p: p["family"] != "")
    return _bound(named, lambda n: F.coalesce(F.try_element_at(F.filter(n, lambda p: ~_in(p["family"], FILTERS)), F.lit(1)), F.try_element_at(n, F.lit(1))))


def family_of_segments(segments_: Column, depth: int = 0) -> Column:
    return F.coalesce(_picked(segments_, depth)["family"], F.lit("sh"))


@dataclass(frozen=True)
class Rule:
    """A user's rule about the words from a program on: ``*`` stands for one word (``$1`` and on in ``family``), within a word for any characters;
    a last ``...`` stands for all further words."""

    match: str
    family: str = ""
    kind: str = ""
    heavy: bool | None = None

    @property
    def pattern(self) -> str:
        words = self.match.split()
        rest = bool(words) and words[-1] == "..."
        words = words[:-1] if rest else words
        one = lambda w: rf"([^{_U}]++)" if w == "*" else rf"[^{_U}]*".join(map(re.escape, w.split("*")))
        body = _U.join(map(one, words))
        return rf"(?s)^{body}" + (rf"(?:{_U}.*)?\z" if rest and words else ".*" if rest else r"\z")

    def filled(self, words: Column) -> Column:
        held = self.match.split().count("*")
        piece = lambda p: F.lit(p) if not re.fullmatch(r"\$[1-9]", p) else F.regexp_extract(words, self.pattern, int(p[1])) if int(p[1]) <= held else F.lit("")
        return F.concat(*(piece(p) for p in re.split(r"(\$[1-9])", self.family)))


@dataclass(frozen=True)
class Rules:
    """Rules in their order, and the heavy kinds in theirs; ``notes`` tell what :meth:`read` passed over."""

    rules: tuple[Rule, ...] = ()
    heavy: tuple[str, ...] = HEAVY
    notes: tuple[str, ...] = ()

    @classmethod
    def read(cls, config: object) -> Rules:
        """From a configuration ``{"families": [{"match", "family", "kind", "heavy"}], "heavyKinds": [...]}``; what is wrong in it is left out and noted."""
        if config is None:
            return cls()
        if not isinstance(config, dict):
            return cls(notes=("not an object",))
        rules, notes, heavy = [], [], HEAVY
        listed = config.get("families", [])
        if not isinstance(listed, list):
            listed, notes = [], ["families: not a list"]
        for i, entry in enumerate(listed):
            wrong = cls._fault(entry)
            if wrong:
                notes.append(f"families[{i}]: {wrong}")
            else:
                rules.append(Rule(entry["match"].strip(), entry.get("family", "").strip(), entry.get("kind", ""), entry.get("heavy")))
        if "heavyKinds" in config:
            kinds = config["heavyKinds"]
            if isinstance(kinds, list) and all(k in KINDS for k in kinds) and len(set(kinds)) == len(kinds):
                heavy = tuple(kinds)
            else:
                notes.append("heavyKinds: not a list of kinds")
        return cls(tuple(rules), heavy, tuple(notes))

    @staticmethod
    def _fault(entry: object) -> str:
        if not isinstance(entry, dict):
            return "not an object"
        if not isinstance(entry.get("match"), str) or not entry["match"].strip():
            return "match is missing or empty"
        if "family" in entry and (not isinstance(entry["family"], str) or not entry["family"].strip()):
            return "family is not a text"
        if "kind" in entry and entry["kind"] not in KINDS:
            return "kind is unknown"
        if "heavy" in entry and not isinstance(entry["heavy"], bool):
            return "heavy is not true or false"
        return ""


def line_family(line: Column, kind: Callable[[Column], Column], rules: Rules = Rules()) -> Column:
    """``family, kind, heavy`` of a line, by the first of the ``rules`` that fits, else by the built-in ones; null if the line is null.

    Work out distinct lines once and join back where lines repeat; ``kind`` tells the kind of a family.
    """

    def told(picked: Column) -> Column:
        family = F.coalesce(picked["family"], F.lit("sh"))
        if not rules.rules:
            return _bound(family, lambda f: _bound(kind(f), lambda k: F.struct(f.alias("family"), k.alias("kind"), k.isin(*rules.heavy).alias("heavy"))))
        name, kind_, heavy = family, kind(family), F.lit(None).cast("boolean")
        words = _program_words(picked["words"])
        for rule in reversed(rules.rules):
            fits = words.rlike(rule.pattern)
            shown = F.coalesce(F.nullif(F.trim(F.substring(rule.filled(words), 1, LONGEST)), F.lit("")), family) if rule.family else family
            name = F.when(fits, shown).otherwise(name)
            kind_ = F.when(fits, rule.kind or kind(family)).otherwise(kind_)
            heavy = F.when(fits, F.lit(rule.heavy).cast("boolean")).otherwise(heavy)
        found = F.struct(name.alias("family"), kind_.alias("kind"), heavy.alias("heavy"))
        return _bound(found, lambda f: F.struct(f["family"].alias("family"), f["kind"].alias("kind"), F.coalesce(f["heavy"], f["kind"].isin(*rules.heavy)).alias("heavy")))

    return F.when(line.isNotNull(), _bound(_picked(segments(line), 0), told))


def of_several(found: Column, rules: Rules = Rules()) -> Column:
    """The one of several :func:`line_family` structs that a call counts as: heavy ones first, by their kinds' order, then by that of all kinds; the first of equals.

    No line at all is ``sh``, other, not heavy; null entries are passed over.
    """
    place = lambda k, kinds: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), k), F.lit(0)), F.lit(len(kinds) + 1))
    ranked = F.transform(F.array_compact(found), lambda f, i: F.struct((~f["heavy"]).alias("light"), F.when(f["heavy"], place(f["kind"], rules.heavy or ("",))).otherwise(place(f["kind"], KINDS)).alias("place"), i.alias("i"), f.alias("f")))
    none = F.struct(F.lit("sh").alias("family"), F.lit("other").alias("kind"), F.lit(False).alias("heavy"))
    return F.coalesce(_bound(ranked, F.array_min)["f"], none)


def _argv(words: Column) -> Column:
    is_line = (F.size(words) >= 3) & F.element_at(words, 1).endswith("sh") & F.element_at(words, 2).isin("-c", "-lc")
    return F.when(is_line, F.element_at(words, 3)).otherwise(F.array_join(words, " "))


def command_lines(argument: Column) -> Column:
    """The command lines of a shell call's argument, as an array.

    It may be a plain line, a JSON array of words (``["bash", "-lc", line]`` is that line; entries that are no texts are passed over), a
    JSON object with such a value as ``command`` or ``cmd``, or a script with calls ``exec_command({cmd: "..."})``. Null gives null.
    """
    call = r"""exec_command\(\s*\{[^}]*?(?:\bcmd|"cmd"|'cmd')\s*:\s*("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"""
    decoded = lambda s: F.when(s.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), s, F.lit("}")), "$.x"), F.expr("substring('', 1)"))).otherwise(F.regexp_replace(s, r"(?s)^.|.\z", ""))
    scripted = F.filter(F.transform(F.regexp_extract_all(argument, F.lit(call), F.lit(1)), decoded), lambda s: s != "")
    texts = lambda json: F.transform(
        F.filter(F.from_json(json, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")
    )
    value = F.coalesce(F.get_json_object(argument, "$.command"), F.get_json_object(argument, "$.cmd"))
    as_line = lambda v: F.when(v.rlike(r"^\s*\["), F.coalesce(_bound(texts(v), _argv), v)).otherwise(v)
    return (
        F.when(argument.contains("exec_command("), scripted)
        .when(argument.rlike(r"^\s*\{") & value.isNotNull(), F.array(as_line(value)))
        .when(argument.isNotNull(), F.array(as_line(argument)))
    )
