"""Repair of conversation structure by the cheapest edits: a Viterbi search whose survivors coalesce.

A conversation's roles are to be one system turn or none, then turns of user
and assistant by turns.  A search over the turns keeps the cheapest edits that
lead to each state of that pattern.  Its backpointers are a tree; a branch that
no survivor uses is dropped, and the edits up to the last place where all
survivors still agree are final and leave the tree.  Equal costs go to the
edits whose initials come first in ASCII order: survivors carry the place of
their whole unresolved suffixes in that order, so a tie between two of them is
the comparison of those suffixes, and only the edits just added decide where
both come from one survivor.

Turns are sorted by range, so that a conversation of any length is dealt to
several tasks, and cut in pieces of :data:`PIECE` turns.  A piece that may go
on from an earlier one is searched from every state; the pieces of a
conversation are then joined by the same search over their few ways through.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches, staged

#: Turns of a piece: a power of two.
PIECE = 1 << 16
#: Costs of edits, and of a cut turn that is not deleted.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user, after an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Edits in a script: inserted user and assistant, kept, made user and assistant, deleted; and their initials in an audit.
CODES, INITIALS = "uaKUAD", "IIKRRD"
_AUDIT = str.maketrans(CODES, INITIALS)
#: What is inserted at the end of a conversation in each state.
TAILS = ("", "ua", "a", "")

_BEFORE = {NONE: (("", NONE), ("u", USER), ("ua", ASSISTANT)), SYSTEM: (("", SYSTEM), ("u", USER), ("ua", ASSISTANT)), USER: (("", USER), ("a", ASSISTANT)), ASSISTANT: (("", ASSISTANT), ("u", USER))}


def _steps(initial: str, fault: str) -> list[list[tuple[int, int, str, str]]]:
    """For each state the ways past a turn: state after it, cost, initials, script.  Nothing is inserted before a deleted turn: after it comes first in the order."""
    out = []
    for state in range(4):
        ways = [(state, DELETE, "D", "D")]
        for put, now in _BEFORE[state] if fault in ("", "cut") else ():
            cost = INSERT * len(put) + (CUT if fault else 0)
            if initial == "s" and now == NONE:
                ways.append((SYSTEM, cost, put + "K", put + "K"))
            if initial == "u" and now != USER or initial == "a" and now == USER:
                ways.append((USER if initial == "u" else ASSISTANT, cost, put + "K", put + "K"))
            ways.append((ASSISTANT, cost + REROLE, "", put + "A") if now == USER else (USER, cost + REROLE, "", put + "U"))
        out.append([(to, cost, script.translate(_AUDIT), script) for to, cost, _, script in ways])
    return out


STEPS = {(initial, fault): _steps(initial, fault) for initial in ("s", "u", "a", "") for fault in ("", "cut", "gone")}


class _Node:
    """A place in the tree of backpointers; a node lives as long as a survivor or a child refers to it."""

    __slots__ = ("children", "parent", "script")

    def __init__(self, parent, script: str):
        self.parent, self.script, self.children = parent, script, []
        if parent is not None:
            parent.children.append(self)


def _release(node: _Node) -> None:
    while not node.children and node.parent is not None:
        node.parent.children.remove(node)
        node = node.parent


class Search:
    """The cheapest edits from one state on, a turn at a time.

    ``survivors`` maps a state to (cost, place in the order of suffixes, node).
    """

    def __init__(self, state: int = NONE):
        self.root = _Node(None, "")
        self.survivors = {state: (0, 0, self.root)}

    def step(self, initial: str, fault: str) -> list[str]:
        """Take a turn in; returns the scripts of earlier turns that are now final."""
        steps, best = STEPS[initial if initial in ("s", "u", "a") else "", fault], {}
        for state, (cost, place, node) in self.survivors.items():
            for to, more, initials, script in steps[state]:
                way = (cost + more, place, initials, script, node)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        self._drop_hopeless(best)
        before = [node for _, _, node in self.survivors.values()]
        ordered = sorted(best.items(), key=lambda x: x[1][1:3])
        self.survivors = {to: (way[0], place, _Node(way[4], way[3])) for place, (to, way) in enumerate(ordered)}
        for node in before:
            _release(node)
        final = []
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            final.append(self.root.script)
        return final

    @staticmethod
    def _drop_hopeless(best: dict) -> None:
        """Drop states that cost more, whatever follows, than another one with a detour: it takes at most an insert, or the deletion of a system turn."""
        never = (1 << 60,)
        cost = [best.get(state, never)[0] for state in range(4)]
        user, assistant = min(cost[USER], cost[ASSISTANT] + INSERT), min(cost[ASSISTANT], cost[USER] + INSERT)
        for state, most in ((NONE, assistant + DELETE), (SYSTEM, assistant), (USER, user), (ASSISTANT, assistant)):
            if state in best and cost[state] > most:
                del best[state]

    def unresolved(self, state: int) -> str:
        """The script of the survivor of ``state`` that is not final yet."""
        out, node = [], self.survivors[state][2]
        while node is not self.root:
            out.append(node.script)
            node = node.parent
        return "".join(reversed(out))


def ways_through(turns: list[tuple[str, str]], entries=(NONE,)) -> list[tuple[int, int, int, int, str]]:
    """(entry, exit, cost, place, script) for each of ``entries`` and every state that some cheapest edits end in.

    ``turns`` are pairs of initial and fault.  ``place`` orders the scripts'
    initials; equal ones have the same.
    """
    out = []
    for entry in entries:
        search, final = Search(entry), []
        for initial, fault in turns:
            final += search.step(initial, fault)
        done = "".join(final)
        out += [(entry, state, cost, done + search.unresolved(state)) for state, (cost, _, _) in search.survivors.items()]
    places = {x: i for i, x in enumerate(sorted({script.translate(_AUDIT) for *_, script in out}))}
    return [(entry, end, cost, places[script.translate(_AUDIT)], script) for entry, end, cost, script in out]


def chosen_ways(pieces: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """The (entry, exit) of each piece on the cheapest way through all of them; pieces are lists of (entry, exit, cost, place)."""
    survivors, links = {NONE: (0, 0)}, []
    for ways in pieces:
        best = {}
        for entry, end, cost, place in ways:
            if entry in survivors:
                way = (survivors[entry][0] + cost, survivors[entry][1], place, entry)
                if end not in best or way < best[end]:
                    best[end] = way
        links.append({end: way[3] for end, way in best.items()})
        ordered = sorted(best.items(), key=lambda x: x[1][1:3])
        survivors = {end: (way[0], place) for place, (end, way) in enumerate(ordered)}
    end = min(survivors, key=lambda s: (survivors[s][0] + INSERT * len(TAILS[s]), survivors[s][1]))
    path = []
    for link in reversed(links):
        path.append((link[end], end))
        end = link[end]
    return path[::-1]


def illegal(first: str, second: str) -> bool:
    return first + second not in ("su", "ua", "au")


_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("script", pa.string())]))


def _pieces(conv_type: pa.DataType):
    """Rows sorted by ``seq`` in, one row for each conversation of each piece out."""
    schema = pa.schema([("conv_id", conv_type), ("first_seq", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("opens", pa.string()), ("closes", pa.string()), ("ways", _WAYS)])

    def closed(seq: int, conv, turns: list[tuple[str, str, str]], goes_on: bool) -> dict:
        faults = [fault for _, fault, _ in turns]
        ways = ways_through([(initial, how) for initial, _, how in turns], range(4) if goes_on else (NONE,))
        return {
            "conv_id": conv, "first_seq": seq, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(illegal(a[0], b[0]) for a, b in zip(turns, turns[1:])), "opens": turns[0][0], "closes": turns[-1][0],
            "ways": [dict(zip(("entry", "exit", "cost", "place", "script"), w, strict=True)) for w in ways],
        }

    def run(batches):
        held, seq0, conv0, piece, goes_on = [], 0, None, None, False
        for batch in batches:
            out = []
            for seq, conv, initial, blank, cut, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece != seq // PIECE or conv != conv0:
                    if held:
                        out.append(closed(seq0, conv0, held, goes_on))
                    held, seq0, conv0, goes_on = [], seq, conv, piece != seq // PIECE
                    piece = seq // PIECE
                fault = "blank" if blank else "duplicate" if not first else "truncated" if cut else ""
                held.append((initial, fault, {"": "", "truncated": "cut"}.get(fault, "gone")))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([closed(seq0, conv0, held, goes_on)], schema)

    return lean(run)


def _joined(batches):
    """Pieces sorted by conversation in; for each its entry, exit, inserted tail, and whether it meets the piece before it illegally."""
    columns = ("first_seq", "entry", "exit", "tail", "meets")

    def closed(held):
        path = chosen_ways([[(w["entry"], w["exit"], w["cost"], w["place"]) for w in p["ways"]] for p in held])
        for i, (p, (entry, end)) in enumerate(zip(held, path, strict=True)):
            yield p["first_seq"], entry, end, TAILS[end] if i + 1 == len(held) else "", int(i > 0 and illegal(held[i - 1]["closes"], p["opens"]))

    def batch_of(out):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    held: list[dict] = []
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if held and held[0]["conv_id"] != p["conv_id"]:
                out += closed(held)
                held = []
            held.append(p)
        if out:
            yield batch_of(out)
    if held:
        yield batch_of([*closed(held)])


class Repair(NamedTuple):
    """``conversations``: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    ``turns``: the repaired ones, ``conv_id``, ``seq`` and ``nth`` (their
    order), ``edit`` (K, R or I), ``role`` and ``text``.
    """

    conversations: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The faults of every conversation of ``turns``, the cheapest edits that repair it, and its repaired turns.

    A conversation's turns are taken by ``turn``, nulls first, ties by role,
    then by the SHA-256 of the text; rows equal in all of that are the same.
    A null role or text counts as one space; null ``conv_id`` is a
    conversation like others.  Each turn's first fault counts: blank,
    duplicate (role and text seen before) or truncated (its last character
    that is no white space is none of ``.!?``).  A turn may be kept (0), given
    the role user or assistant (3) or deleted (4; blank and duplicate ones
    must be), and empty turns of either role inserted (3); a truncated turn
    that is not deleted costs 3 more.  Of the cheapest edits, those whose
    initials come first in ASCII order are taken.

    An empty table gives empty results; other columns are not read.  A
    conversation of any length is dealt to many tasks; one holds
    :data:`PIECE` turns without their texts, and texts of any length only
    pass through.  The audit of a conversation is one value of a row.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("salt"),
    ).withColumn("digest", F.sha2("text", 256))
    order = ("conv_id", "turn", "role", "digest", "salt")
    ordered = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("salt").withColumn("seq", F.monotonically_increasing_id()), "turns")
    first = ordered.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    judged = ordered.select(
        "seq", "conv_id", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")
    ).join(first, "seq", "left")
    small_batches(spark)
    kind = dict(ordered.dtypes)["conv_id"]
    arrow_kind = spark.createDataFrame([], ordered.select("conv_id").schema).toArrow().schema.field(0).type
    dealt = judged.repartition(n, F.expr(f"seq div {PIECE}")).sortWithinPartitions("seq").select("seq", "conv_id", "initial", "blank", "cut", F.coalesce("first", F.lit(False)).alias("first"))
    pieces = staged(
        dealt.mapInArrow(
            _pieces(arrow_kind),
            f"conv_id {kind}, first_seq long, blank long, duplicate long, truncated long, illegal long, opens string, closes string, ways array<struct<entry:int,exit:int,cost:long,place:int,script:string>>",
        ),
        "pieces",
    )
    slim = pieces.select("conv_id", "first_seq", "opens", "closes", F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["exit"].alias("exit"), w["cost"].alias("cost"), w["place"].alias("place"))).alias("ways"))
    joined = slim.repartition(n, "conv_id").sortWithinPartitions("conv_id", "first_seq").mapInArrow(_joined, "first_seq long, entry int, exit int, tail string, meets long")
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")))[0]
    scripts = staged(
        pieces.join(joined, "first_seq").withColumn("way", way).select(
            "conv_id", "first_seq", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("meets")).alias("illegal"),
            (F.col("way.cost") + INSERT * F.length("tail")).alias("cost"), F.col("way.script").alias("script"), "tail",
        ),
        "scripts",
    )
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_seq", F.concat("script", "tail").alias("script")))), lambda x: x["script"]), "")
    sums = scripts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.translate(audit, CODES, INITIALS).alias("audit"))
    known = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = ordered.groupBy("conv_id").agg(F.coalesce(known, F.lit(0)).cast("long").alias("gaps"))
    conversations = gaps.join(sums.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    blocks = scripts.select("conv_id", "first_seq", F.posexplode(F.regexp_extract_all("script", F.lit("[ua]*[KUAD]"), 0)).alias("at", "block"))
    edits = blocks.select((F.col("first_seq") + F.col("at")).alias("seq"), "block").where("block <> 'D'").join(ordered.select("seq", "conv_id", "role", "text"), "seq")
    made = lambda c: F.struct(
        F.translate(c, CODES, INITIALS).alias("edit"),
        F.when(F.lower(c) == "u", "user").when(F.lower(c) == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(c.isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
    )
    letters = lambda c: F.array_remove(F.split(c, ""), "")
    inner = edits.select("conv_id", "seq", F.posexplode(F.transform(letters(F.col("block")), made)).alias("nth", "x"))
    ends = scripts.where("tail <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"), "tail")
    tails = ends.select("conv_id", "seq", F.posexplode(F.transform(letters(F.col("tail")), made)).alias("nth", "x"))
    return Repair(conversations, inner.unionByName(tails).select("conv_id", "seq", "nth", "x.edit", "x.role", "x.text"))


def _hashed(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("repaired_sha256", pa.string())])

    def run(batches):
        digest, now, seen = None, None, False
        for batch in batches:
            out = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if seen and conv == now:
                    digest.update(b"\n")
                else:
                    if seen:
                        out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                    digest, now, seen = hashlib.sha256(), conv, True
                digest.update(line.as_py().encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if seen:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], schema)

    return lean(run)


def line_digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of its ``role:text`` lines, joined by newlines.

    A hash is a chain, so a conversation is read by one task, but a line at a
    time: what it holds does not grow with the conversation.
    """
    spark = turns.sparkSession
    small_batches(spark)
    kind = spark.createDataFrame([], turns.select("conv_id").schema).toArrow().schema.field(0).type
    dealt = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "seq", "nth")
    return dealt.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(_hashed(kind), f"conv_id {dict(turns.dtypes)['conv_id']}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The query's own input: turns dropped, emptied, cut, repeated or given to the user by a checksum of their id."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))), F.lit(20)).alias("how"))
    how: Column = F.col("how")
    return plain.where(how != 0).select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(table))
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    both = (
        table.select("conv_id").distinct()
        .join(found.conversations.withColumnRenamed("conv_id", "of"), same("of"), "left")
        .join(line_digests(found.turns).withColumnRenamed("conv_id", "hashed"), same("hashed"), "left")
    )
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )


QUERIES = {"op11_conversation_repair": op11_conversation_repair}


def _put(source: str, cost: str, audit: str, lines: str) -> str:
    return f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{audit}', 'r': {source}.r || {lines}}}"


_U, _A, _LINE = "'user:' || chr(10)", "'assistant:' || chr(10)", "x.role || ':' || x.text || chr(10)"
#: For each state, what it is once empty turns are put before the next one.
_OPEN_USER = f"list_min([acc.u, {_put('acc.n', '3', 'I', _U)}, {_put('acc.s', '3', 'I', _U)}, {_put('acc.a', '3', 'I', _U)}])"
_OPEN_REST = f"list_min([acc.n, acc.s, acc.a, {_put('acc.n', '6', 'II', f'{_U} || {_A}')}, {_put('acc.s', '6', 'II', f'{_U} || {_A}')}, {_put('acc.u', '3', 'I', _A)}])"
_INFINITE = "{'c': 1000000000, 'a': '', 'r': ''}"

ORACLE_SQL = {
    "op11_conversation_repair": rf"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) g(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS bytes
  FROM conversations
), how AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS how FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM how WHERE how <> 0
), flagged AS (
  SELECT *, sha256(text) AS digest, substr(role, 1, 1) AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS is_again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN is_blank THEN 'blank' WHEN is_again THEN 'duplicate' WHEN is_cut THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy) AS before
  FROM flagged
), rows AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'i': initial, 'gone': fault IN ('blank', 'duplicate'), 'more': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'role': role, 'text': text}}
              ORDER BY turn NULLS FIRST, role, digest, copy) AS turns
  FROM judged GROUP BY conv_id
), ends AS (
  SELECT * EXCLUDE turns, list_reduce(turns, lambda acc, x: {{
    'n': {_put("acc.n", "4", "D", "''")},
    's': list_min([{_put("acc.s", "4", "D", "''")}, CASE WHEN NOT x.gone AND x.i = 's' THEN {_put("acc.n", "x.more", "K", _LINE)} END]),
    'u': list_min([{_put("acc.u", "4", "D", "''")},
                   CASE WHEN NOT x.gone AND x.i = 'u' THEN {_put(_OPEN_REST, "x.more", "K", _LINE)} END,
                   CASE WHEN NOT x.gone THEN {_put(_OPEN_REST, "x.more + 3", "R", "'user:' || x.text || chr(10)")} END]),
    'a': list_min([{_put("acc.a", "4", "D", "''")},
                   CASE WHEN NOT x.gone AND x.i = 'a' THEN {_put(_OPEN_USER, "x.more", "K", _LINE)} END,
                   CASE WHEN NOT x.gone THEN {_put(_OPEN_USER, "x.more + 3", "R", "'assistant:' || x.text || chr(10)")} END])
  }}, {{'n': {{'c': 0, 'a': '', 'r': ''}}, 's': {_INFINITE}, 'u': {_INFINITE}, 'a': {_INFINITE}}}) AS acc FROM rows
), done AS (
  SELECT * EXCLUDE acc, list_min([acc.n, {_put("acc.s", "6", "II", f"{_U} || {_A}")}, {_put("acc.u", "3", "I", _A)}, acc.a]) AS best FROM ends
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""
}
