"""Kinds of command families, of tools and of events; :mod:`loomspan.functions.shell` reads the lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import shell
from loomspan.functions.scalars import mcp_server, tool_category

# Kinds of families by words.
KIND_WORDS = (
    ("test", ("test", "tests", "vitest", "jest", "mocha", "pytest", "playwright", "cypress", "rspec", "check.sh", "e2e", "nextest", "cargo test", "go test", "mix test")),
    ("typecheck", ("tsc", "typecheck", "type-check", "check-types", "mypy", "pyright", "vue-tsc", "svelte-check", "cargo check")),
    ("lint", ("lint", "eslint", "biome", "ruff", "clippy", "prettier", "shellcheck", "golangci-lint", "stylelint", "fmt", "format", "vet")),
    ("build", ("build", "compile", "make", "webpack", "vite build", "esbuild", "rollup", "next build", "tsup", "cargo build", "go build", "docker build")),
    ("install", ("install", "pip", "pip3", "uv sync", "go mod", "bundle install")),
    ("ci", ("gh run", "gh pr checks", "gh workflow", "act")),
    ("wait", ("sleep", "wait")),
    ("vcs", ("git",)),
    ("net", ("ssh", "scp", "rsync", "curl", "wget")),
)

# Tools by name, for kinds of tools and of events.
USER_TOOLS = ("askuserquestion", "ask_user", "askuser")
WAIT_TOOLS = ("taskoutput", "bashoutput", "monitor", "wait", "write_stdin", "killshell")
AGENT_TOOLS = ("agent", "task", "sendmessage", "spawn_agent", "send_input", "wait_agent")
WEB_TOOLS = ("webfetch", "websearch", "google_web_search")
FILE_TOOLS = ("read", "edit", "write", "grep", "glob", "ls", "notebookedit", "multiedit", "apply_patch", "read_file", "write_file", "replace", "list_directory", "read_many_files", "search_file_content", "patch")
EDIT_TOOLS = ("edit", "write", "multiedit", "notebookedit", "apply_patch", "write_file", "replace", "patch", "str_replace_editor", "create_file")
SEARCH_TOOLS = ("grep", "glob", "ls", "list_directory", "search_file_content", "find", "list", "codesearch", "rg")
SKILL_TOOLS = ("skill", "activate_skill")


def family(command: Column) -> Column:
    """Family of a shell line; ``sh`` if it has only trivial parts, null if it is null."""
    return shell.line_family(command, kind)["family"]


def call_family(argument: Column, rules: shell.Rules = shell.Rules()) -> Column:
    """``family, kind, heavy`` of a shell call by its argument in any of the forms of :func:`~loomspan.functions.shell.command_lines`; null if that is null."""
    lines = F.transform(shell.command_lines(argument), lambda line: shell.line_family(line, kind, rules))
    return F.when(argument.isNotNull(), shell.of_several(lines, rules))


def kind(family_: Column) -> Column:
    """test, typecheck, lint, build, install, ci, wait, vcs, net or other, by the words of a family."""
    tokens = F.split(family_, " ")
    words = F.split(family_, r"[ :._/-]+")

    def told(name: str, list_: tuple[str, ...]) -> Column:
        """A phrase leads the family; a word is one of its tokens or a part of one; for vcs, net and wait it is the program."""
        phrases = [w for w in list_ if " " in w]
        single = [w for w in list_ if " " not in w]
        if name in ("vcs", "net", "wait"):
            return F.element_at(tokens, 1).isin(*single)
        found = [(family_ == w) | family_.startswith(w + " ") for w in phrases]
        if single:
            found.append(F.arrays_overlap(F.concat(tokens, words), F.array(*map(F.lit, single))))
        return reduce(Column.__or__, found)

    cases = reduce(lambda c, k: c.when(told(*k), k[0]), KIND_WORDS, F.when(F.array_contains(words, "mcp"), "other"))
    return cases.otherwise("other")


def tool_kind(tool: Column) -> Column:
    """user, wait, agent, web, mcp, file or other, for tools that are no shell."""
    low = F.lower(tool)
    return (
        F.when(low.isin(*USER_TOOLS) | low.startswith("request_user_input"), "user")
        .when(low.isin(*WAIT_TOOLS), "wait")
        .when(low.isin(*AGENT_TOOLS), "agent")
        .when(low.isin(*WEB_TOOLS) | low.startswith("web_"), "web")
        .when(low.startswith("mcp_"), "mcp")
        .when(low.isin(*FILE_TOOLS), "file")
        .otherwise("other")
    )


def event_kinds(tool: Column, argument: Column, failed: Column) -> Column:
    """Kinds of a call's event, as an array: one by its tool and argument text (a shell's command line), and ``error`` if it failed.

    Kinds are ``family`` or ``family:name``. A null tool or argument tells nothing: ``other``, or ``shell:other``.
    """
    low = F.lower(tool)
    proxied = F.when(low == "mcp", F.regexp_extract(argument, "^([^/]+)/", 1))
    server = F.lower(F.coalesce(F.nullif(mcp_server(tool), F.lit("")), F.nullif(proxied, F.lit("")), F.lit("unknown")))
    group, category = tool_kind(tool), tool_category(tool)
    made = (
        F.when((low == "mcp") | low.startswith("mcp__"), F.concat(F.lit("mcp:"), server))
        .when(low.isin(*SKILL_TOOLS), "skill:load")
        .when(group == "user", "approval")
        .when(group == "agent", "subagent")
        .when(group == "web", "web")
        .when(low.isin(*EDIT_TOOLS), "edit")
        .when((group == "file") | (category == "read"), F.when(low.isin(*SEARCH_TOOLS), "read:search").otherwise("read"))
        .when(group == "wait", "shell:wait")
        .when(category == "shell", F.concat(F.lit("shell:"), F.coalesce(call_family(argument)["kind"], F.lit("other"))))
        .when(category == "edit", "edit")
        .when(category == "web", "web")
        .when(category == "agent", "subagent")
        .otherwise("other")
    )
    return F.array_compact(F.array(made, F.when(failed, "error")))
