"""Turns as a running summary: the automaton of a session's log goes on where the last micro-batch or run stopped.

A line is ``session, place, kind, t_ms, ms`` with kinds as in :mod:`loomspan.operators.turns`, whose ``turn_spans`` is the batch twin.
The state of a session is one open turn and a few numbers, however long its log; Spark keeps it in the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.turns import CLOSERS, OPENERS
from loomspan.streaming.open_calls import in_order, replay, told

_TURN = "turn long, opened_by string, place long, prompt_place long, t0 long, t1 long, closed_by string, late boolean"
_NAMES = [c.split()[0] for c in _TURN.split(", ")]
_LINE = ["place", "kind", "t_ms", "ms"]


class TurnMachine:
    """The automaton of one session; :meth:`step` gives the turn that a line closed, if any, as a dict."""

    def __init__(self, quiet_ms: int | None = None, held: dict | None = None):
        self.quiet_ms = quiet_ms
        self.held = held or {"n": 0, "last": None, "turn": None, "waits": False, "paused": False}

    def _close(self, why: str, end: int | None) -> dict:
        turn, self.held["turn"], self.held["waits"], self.held["paused"] = self.held["turn"], None, False, why == "quiet"
        return self._seen(turn, why, end)

    @staticmethod
    def _seen(turn: dict, why: str, end: int | None) -> dict:
        times = [t for t in (turn["t"], end) if t is not None]
        return {**{k: turn[k] for k in _NAMES if k in turn}, "t1": max(times, default=None), "closed_by": why}

    def step(self, place: int, kind: str | None, t_ms: int | None, ms: int | None) -> list[dict]:
        h, out, before = self.held, [], self.held["last"]
        t = before if t_ms is None else t_ms
        h["last"] = t if before is None else max(before, t)
        if h["turn"] and self.quiet_ms is not None and before is not None and t - before > self.quiet_ms:
            out.append(self._close("quiet", before))
        if kind == "prompt" and h["waits"]:
            h["waits"], h["turn"]["prompt_place"] = False, place
        elif kind in CLOSERS and h["turn"]:
            if ms and ms > 0 and t is not None:
                h["turn"]["t0"] = t - ms if h["turn"]["t0"] is None else min(h["turn"]["t0"], t - ms)
            out.append(self._close(kind, h["last"]))
        elif kind in OPENERS and not (kind == "activity" and h["turn"]):
            if h["turn"]:
                out.append(self._close("next", h["last"]))
            h["n"] += 1
            late = kind == "activity" and h["paused"]
            h["turn"] = {"turn": h["n"], "opened_by": kind, "place": place, "prompt_place": place if kind == "prompt" else None, "t": t, "t0": t, "late": late}
            h["waits"], h["paused"] = kind == "started", False
        return out

    def open_turn(self) -> list[dict]:
        return [self._seen(self.held["turn"], "open", self.held["last"])] if self.held["turn"] else []


def running_turns(lines: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """A stream of lines to rows ``session`` and a turn's columns; of each turn the last row holds (:func:`settled_turns`).

    A turn is told when it closes, and as ``open`` at the end of each micro-batch that leaves it open. The lines of a session within a
    micro-batch are put in order of ``place``; batches must follow each other in that order, as the appended parts of a log do. A session's
    lines of one micro-batch are in memory at once (bound them by the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``).
    Lines with a null session are one session.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = TurnMachine(quiet_ms, json.loads(state.get[0]) if state.exists else None)
        number = lambda x: None if x is None else int(x)
        rows, place = [], 0
        for place, kind, t_ms, ms in in_order(parts, _LINE):
            rows += machine.step(int(place), kind, number(t_ms), number(ms))
        rows += machine.open_turn()
        state.update((json.dumps(machine.held),))
        yield from told([(key[0], *(r.get(c) for c in _NAMES), int(place)) for r in rows], ["session", *_NAMES, "at"])

    return lines.groupBy("session").applyInPandasWithState(run, f"session string, {_TURN}, at long", "held string", "append", GroupStateTimeout.NoTimeout)


def settled_turns(rows: DataFrame) -> DataFrame:
    """One row per turn of the stream's output: the one told last."""
    latest = rows.groupBy("session", "turn").agg(F.max_by(F.struct(*_NAMES[1:]), F.struct("at", F.col("closed_by") != "open")).alias("_r"))
    return latest.select("session", "turn", "_r.*")


def replayed_turns(lines: DataFrame, order: str, parts: int, quiet_ms: int | None = None) -> DataFrame:
    """A table of lines as the log it might have been, read in ``parts`` runs; each goes on from the checkpoint of the one before."""
    return settled_turns(replay(lines, order, parts, lambda s: running_turns(s, quiet_ms), f"session string, {_TURN}, at long", "running-turns"))
