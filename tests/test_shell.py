"""Shell lines: tokens, families, user rules, several commands, arguments."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspan.functions import families, shell

# line, family, kind: shapes of our own
SHAPES = [
    ("cd /srv/a && mkdir -p x && yarn", "yarn install", "install"),
    ("git -C /srv/a -c user.name=x commit -m 'one; two && three | four'", "git commit", "vcs"),
    ('echo "a && make" ; eslint src', "eslint", "lint"),
    ("printf %s 'it''s' \"two \\\" ; words\" | sort -u", "sort", "other"),
    ("cat <<EOF > a.txt\nmake; npm test\nEOF\ngo build ./...", "go build", "build"),
    ("cat <<-'X Y' | tr a b\nmake\nX Y", "cat", "other"),
    ("python3 - <<'PY' import os; os.system('make') PY", "python3", "other"),
    ("cat <<EOF never closed && make", "cat", "other"),
    ("grep -c 'x' <<< 'make' | wc", "grep", "other"),
    ("make -C sub -j 4 lint 2>&1 | tee log", "make lint", "lint"),
    ("npm --prefix web run -- e2e:ci &> out.txt", "npm run e2e:ci", "test"),
    ("npm -w 3 t > out.txt 2> err.txt", "npm test", "test"),
    ("bun add left-pad", "bun install", "install"),
    ("yarn workspace @a/b dlx playwright test", "playwright", "test"),
    ("pnpm dlx @a/tool@2.1 --x", "@a/tool", "other"),
    ("npx --package x -c 5 tsc@5.4 -b", "tsc", "typecheck"),
    ("uv --directory /s run --group dev python -m pytest -q", "pytest", "test"),
    ("poetry run mypy .", "mypy", "typecheck"),
    ("bundle exec rake test", "rake test", "test"),
    ("python3.11 -m pip install x", "pip install", "install"),
    ("python -W error tools/report.py 3", "python report.py", "other"),
    ("node --import ./hook.js -e 'run()'", "node", "other"),
    ("ruby -- scripts/build.rb", "ruby build.rb", "build"),
    ("sudo -u ci -E nice -n 5 timeout -k 5 10m stdbuf -o L cargo +nightly --config x nextest run", "cargo nextest", "test"),
    ("flock -w 9 /tmp/l -c 4 dotnet test", "dotnet test", "test"),
    ("env -u A B=2 C=3 xargs -n 1 -P 8 shellcheck", "shellcheck", "lint"),
    ("if ! kubectl -n prod get pods; then exit 1; fi", "kubectl get", "other"),
    ("for f in *.c; do gcc $f; done", "gcc", "other"),
    ("while sleep 1; do :; done", "sleep", "wait"),
    ("{ ( cd a; gh -R a/b pr checks 3 ); }", "gh pr checks", "ci"),
    ("gh run watch", "gh run watch", "ci"),
    ("go tool ./bin/vet x", "go tool vet", "lint"),
    ("bash -x -c 'cd a && sh -c \"zsh -lc \\\"terraform plan\\\"\"'", "terraform plan", "other"),
    ("sh -c 'echo hi'", "sh", "other"),
    ("bash --norc -c 'cat x' && make", "make", "build"),
    ("bash -c", "bash", "other"),
    ("fish", "fish", "other"),
    ("trap 'rm x; make' EXIT TERM", "sh", "other"),
    ("trap 'rm x' EXIT curl -s localhost", "curl", "net"),
    ("sleep 5 & rsync -a b c", "sleep", "wait"),
    ("./a\\ b/run.sh", "run.sh", "other"),
    ("ls >& out", "ls", "other"),
    ("playwright-mcp test", "playwright-mcp", "other"),
    ("", "sh", "other"),
    ("   ", "sh", "other"),
    (";;|&&", "sh", "other"),
    ("'", "sh", "other"),
    ("<<", "sh", "other"),
    ("x" * 50 + " y", "x" * 40, "other"),
    (None, None, None),
]


def test_lines_by_family_and_kind(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(SHAPES)], "line string, f string, k string, i int")
    got = {r["i"]: (r["family"], r["kind"]) for r in df.select("i", shell.line_family(F.col("line"), families.kind).alias("g")).select("i", "g.family", "g.kind").collect()}
    assert [(SHAPES[i][0], *got[i]) for i in sorted(got)] == SHAPES


def test_very_long_lines_need_no_deep_stack(spark):
    long = ["a" * 2_000_000, "x '" + "q; " * 300_000 + "' && make", 'x "' + '\\" ' * 300_000, "cd a; " * 100_000 + "make test", "tool " + "--opt 1 " * 100_000, "cat <<E\n" + "b\n" * 300_000 + "E\nmake"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(long)], "i int, line string")
    got = [r[1] for r in df.select("i", families.family(F.col("line"))).orderBy("i").collect()]
    assert got == ["a" * 40, "x", "x", "make test", "tool", "make"]


def test_user_rules(spark):
    rules = shell.Rules.read(
        {
            "families": [
                {"match": "deploy * to *", "family": "$2 gets $1$3", "kind": "ci"},
                {"match": "run-* ...", "family": "runner"},
                {"match": "slow", "heavy": True},
                {"match": "make fast ...", "heavy": False, "kind": "build"},
                {"match": "make ...", "family": "never $9"},
                {"match": " "}, {"match": "x", "kind": "odd"}, {"match": "x", "heavy": 1}, {"match": "x", "family": " "}, 3,
            ]
        }
    )
    assert len(rules.rules) == 5 and [n.split(":")[0] for n in rules.notes] == [f"families[{i}]" for i in range(5, 10)]
    lines = ["cd a; sudo deploy 'my app' to prod | cat", "deploy a to b c", "run-all", "run-it x y", "slow", "slow x", "make fast", "make fast -j", "make faster"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = df.select("i", shell.line_family(F.col("line"), families.kind, rules).alias("g")).orderBy("i").select("g.*").collect()
    assert [tuple(r) for r in got] == [
        ("prod gets my app", "ci", False), ("deploy", "other", False), ("runner", "other", False), ("runner", "other", False), ("slow", "other", True), ("slow", "other", False),
        ("make fast", "build", False), ("make fast", "build", False), ("never", "build", True),
    ]


@pytest.mark.parametrize("config", [None, {}, {"heavyKinds": ["odd"]}, {"families": 3}, 7])
def test_wrong_configurations_leave_the_defaults(config):
    rules = shell.Rules.read(config)
    assert rules.heavy == shell.HEAVY and rules.rules == () and bool(rules.notes) == (config not in (None, {}))


def test_a_call_of_several_commands_is_its_heaviest(spark):
    rows = [(0, ["git log", "make", "pytest"]), (1, ["curl x", "git log", "ls"]), (2, ["ls", "cp a b"]), (3, []), (4, None), (5, [None, "ls"]), (6, ["npm ci", "tsc"])]
    df = spark.createDataFrame(rows, "i int, lines array<string>")

    def told(rules):
        found = shell.of_several(F.transform("lines", lambda line: shell.line_family(line, families.kind, rules)), rules)
        return [r[0] for r in df.select("i", found.alias("g")).orderBy("i").select("g.family").collect()]

    assert told(shell.Rules()) == ["pytest", "git log", "ls", "sh", "sh", "ls", "tsc"]
    assert told(shell.Rules(heavy=("vcs", "build"))) == ["git log", "git log", "ls", "sh", "sh", "ls", "tsc"]


def test_arguments_of_calls(spark):
    rows = [
        ("ls -l", ["ls -l"]), ('["bash","-lc","a b"]', ["a b"]), ('["/bin/zsh","-c","a"]', ["a"]), ('["a",1,"b",null]', ["a b"]), ("[broken", ["[broken"]), ("[ -f x ] && ls", ["[ -f x ] && ls"]),
        ('{"command":["x","y"]}', ["x y"]), ('{"cmd":"make \\"q\\""}', ['make "q"']), ('{"other":1}', ['{"other":1}']), ("", [""]), (None, None),
        ('exec_command({cmd:"a \\"q\\" b"}); exec_command({x:1, "cmd": \'z\'}); exec_command({cmd: ""})', ['a "q" b', "z"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, argument string, lines array<string>")
    got = [r[0] for r in df.select("i", shell.command_lines(F.col("argument")).alias("l")).orderBy("i").select("l").collect()]
    assert got == [r[1] for r in rows]
