"""The stream of turns: restart from the checkpoint, resets and isolation of sessions."""

import datetime as dt
import random

from pyspark.sql import Row

from lodestone.operators.graph import RESTART
from lodestone.operators.staging import fresh_path
from lodestone.streaming.turns import TurnProcessor, run_turns

SCHEMA = "session string, ts timestamp, turn_id long, kind string, node_id string, option_id string, label string"
EDGES = [("root", 1, "a", "A", "m"), ("m", 1, "b", "B", "end"), ("m", 2, "c", "C", "n"), ("n", 1, "up", "Up", "root"), ("end", 1, RESTART, "Again", "root")]


def plain(turns):
    """The states after each turn, in plain Python."""
    edges, states, out = {(n, o): t for n, _, o, _, t in EDGES}, {}, {}
    for session, _, turn, kind, node, option, label in sorted(turns, key=lambda t: (t[1], t[2])):
        s = states.setdefault(session, [0, 0, None, False, 0, None])
        error = None
        if kind == "reset":
            s[:] = [s[0] + 1, 0, None, False, 0, None]
        elif kind == "text":
            s[1:] = [s[1] + 1, None, False, 0, turn]
        elif (node, option) not in edges:
            error = "invalid_action"
        elif option == RESTART or edges[node, option] == "root":
            s[1:] = [s[1] + 1, edges[node, option], False, 0, turn]
        else:
            s[2:5] = [edges[node, option], edges[node, option] == "end", s[4] + bool(label)]
        out[session, turn] = (error, s[2], s[3], s[1], f"{session}:{s[0]}", s[4], s[5])
    return out


def test_state_survives_a_restart(spark):
    rng, base = random.Random(5), fresh_path(spark, "turns")
    turns = []
    for i in range(160):
        kind = rng.choice(["action"] * 6 + ["text", "reset"])
        node, _, option, label, _ = rng.choice([*EDGES, ("m", 9, "zz", "Z", "?")])
        act = kind == "action"
        turns.append((rng.choice("abc"), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), i, kind, node if act else None, option if act else None, rng.choice([label, "", None]) if act else None))
    edges = spark.createDataFrame(EDGES, "node_id string, ord long, option_id string, label string, next_node_id string")
    ends = spark.createDataFrame([("end",)], "node_id string")
    landed = spark.createDataFrame([], SCHEMA)
    for low, high in ((0, 40), (40, 90), (90, 160)):  # each call takes in what landed since the last one
        for at in range(low, high, 25):
            some = turns[at : min(at + 25, high)]
            rng.shuffle(some)
            spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        found = run_turns(spark, f"{base}/in", landed.schema, lambda x: x, edges, ends, "root", f"{base}/out", f"{base}/state", files=1)
        got = {(r["session"], r["turn_id"]): tuple(r[c] for c in ("error", "position", "completed", "epoch", "thread", "labels", "since")) for r in found.collect()}
        assert got == plain(turns[:high])


def test_a_session_is_taken_row_by_row(spark):
    class State:
        kept = None

        def get(self):
            return self.kept

        def update(self, now):
            self.kept = now

        def clear(self):
            self.kept = None

    processor = TurnProcessor("root")
    processor.state = State()
    turn = lambda ts, n, kind: Row(session="a", ts=ts, turn_id=n, kind=kind, option_id="b", label="B", next_node_id="end", is_end=True, error=None)
    rows = [turn(dt.datetime(2024, 1, 2), 2, "action"), turn(None, 3, "action"), turn(dt.datetime(2024, 1, 1), 1, "text")]
    got = [(r.turn_id, r.position, r.completed, r.epoch, r.labels, r.since) for r in processor.handleInputRows(("a",), iter(rows), None)]
    assert got == [(1, None, False, 1, 0, 1), (2, "end", True, 1, 1, 1), (3, "end", True, 1, 2, 1)] and processor.state.kept == (0, 1, "end", True, 2, 1)
    list(processor.handleInputRows(("a",), iter([turn(None, 4, "reset")]), None))
    assert processor.state.kept == (1, 0, None, False, 0, None)
