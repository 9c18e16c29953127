"""Conversations whose turns don't alternate: the cheapest edits that mend them.

A conversation is right if the first letters of its roles spell ``(s?(ua)+)?``: a system
turn or none, then user and assistant in turn.  The grammar has four states.  Edits are the
edges of a lattice of (rows read, state): keep or rename or delete a row, or insert an
empty one.  Dijkstra's algorithm walks it without building it, its key the cost and the
edits' letters so far, and stops at the first end node it takes out that the grammar
accepts.  The letters fix the cost of a path, so of two equally dear paths to a node neither
begins the other, and what follows can't change which of them is first.

Conversations are sorted by range, so a long one lies in several partitions.  The walk reads
rows without their texts, in blocks of at most BLOCK rows.  A conversation that doesn't lie
in one block comes in pieces: each is walked from every state to every state, and the
pieces' tables are put together in order.  So no task reads a conversation's texts but the
one that takes a digest of them, which is a stream.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import workspace

PIECE = 256  # rows walked together
BLOCK = 1 << 14  # rows dealt to a task together
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

_SPACE = " \t\n\x0b\f\r"
_MARKS = ".!?"
_LEGAL = ("su", "ua", "au")

# -- the lattice

START, SYSTEM, USER, ASSISTANT = range(4)
_ACCEPTING = (START, ASSISTANT)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEW = (USER, USER, ASSISTANT, USER)  # where a user or assistant turn leads from each state
#: A row is its role's first letter, or - for any other; a capital or _ if truncated; D if it must go.
_TRUNCATED = {"s": "S", "u": "U", "a": "A", "-": "_"}
_LETTERS = {v: k for k, v in _TRUNCATED.items()}


def letter(initial: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "D"
    plain = initial if initial in ("s", "u", "a") else "-"
    return _TRUNCATED[plain] if fault == "truncated" else plain


def walk(rows: str, entry: int = START) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edits) of the end nodes, the cheapest first and of equals the least."""
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            yield state, cost, edits
        heapq.heappush(heap, (cost + INSERT, edits + "I", i, _NEW[state]))
        if i < len(rows):
            row = rows[i]
            heapq.heappush(heap, (cost + DELETE, edits + "D", i + 1, state))
            if row != "D":
                more = TRUNCATED if row in _LETTERS else 0
                heapq.heappush(heap, (cost + RENAME + more, edits + "R", i + 1, _NEW[state]))
                kept = _KEEP.get((state, _LETTERS.get(row, row)))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, kept))


@functools.lru_cache(maxsize=1 << 15)
def cheapest(rows: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation: the first accepting end."""
    return next((cost, edits) for state, cost, edits in walk(rows) if state in _ACCEPTING)


def crossings(rows: str) -> list[tuple[int, int, int, str]]:
    """(entry, end, cost, edits) of a piece, for all states that can be reached."""
    return [(entry, *end) for entry in range(4) for end in walk(rows, entry)]


def applied(rows: str, edits: str, state: int) -> tuple[list[tuple[int | None, str, str | None]], int]:
    """(row or None, edit, new role or None) in order, and the state after them."""
    out, i = [], 0
    for e in edits:
        if e in "IR":
            state = _NEW[state]
            out.append((None if e == "I" else i, e, "user" if state == USER else "assistant"))
        else:
            if e == "K":
                state = _KEEP[state, _LETTERS.get(rows[i], rows[i])]
            out.append((i, e, None))
        i += e != "I"
    return out, state


class Joined:
    """Pieces of one conversation, put together in their order.

    ``live`` has, for each state, cost and the edits of the pieces on which the ways so
    far don't agree; those on which they do are given out.
    """

    def __init__(self):
        self.live: dict[int, tuple[int, list[tuple[int, str]]]] = {START: (0, [])}
        self.waiting: deque = deque()

    def _agreed(self, ways: list) -> Iterator[tuple[object, int, str]]:
        while self.waiting and all(w[0] == ways[0][0] for w in ways):
            yield (self.waiting.popleft(), *ways[0][0])
            for w in ways:
                w.pop(0)

    def add(self, piece, table: list[tuple[int, int, int, str]]) -> Iterator[tuple[object, int, str]]:
        """Takes a piece; gives (piece, entry, edits) for those that are settled."""
        best: dict[int, tuple[int, str, int, str]] = {}
        so_far = {s: "".join(e for _, e in way) for s, (_, way) in self.live.items()}
        for entry, end, cost, edits in table:
            if entry in self.live:
                key = (self.live[entry][0] + cost, so_far[entry] + edits, entry, edits)
                if end not in best or key < best[end]:
                    best[end] = key
        # From START or SYSTEM nothing follows that ASSISTANT can't follow by deleting one row more at most.
        if START in best and best[START][0] > best[ASSISTANT][0] + DELETE:
            del best[START]
        if SYSTEM in best and best[SYSTEM][0] > best[ASSISTANT][0]:
            del best[SYSTEM]
        self.live = {end: (cost, [*self.live[entry][1], (entry, edits)]) for end, (cost, _, entry, edits) in best.items()}
        self.waiting.append(piece)
        yield from self._agreed([way for _, way in self.live.values()])

    def close(self) -> Iterator[tuple[object, int, str]]:
        """The rest of the cheapest way that the grammar accepts."""
        _, way = min(((cost, "".join(e for _, e in way)), way) for s, (cost, way) in self.live.items() if s in _ACCEPTING)
        self.live = {START: (0, way)}
        yield from self._agreed([way])


# -- pieces of sorted rows

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class Piece:
    """Neighbouring rows of one conversation."""

    def __init__(self, conv, first: int):
        self.conv, self.first, self.rows = conv, first, []
        self.first_role = self.last_role = self.low = self.high = None
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.whole = False

    def add(self, turn, initial: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.last_role is None:
            self.first_role = initial
        else:
            self.counts["illegal"] += self.last_role + initial not in _LEGAL
        self.last_role = initial
        if turn is not None:
            self.counts["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows.append(letter(initial, fault))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Pieces of at most PIECE rows from rows in order of seq; whole ones are marked."""
    piece, seen, opens = None, None, False
    for batch in batches:
        for conv, turn, seq, initial, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "seq", "initial", "fault")]):
            follows = seen is not None and seq == seen + 1
            if piece is None or not follows or conv != piece.conv or len(piece.rows) == PIECE:
                if piece is not None:
                    piece.whole = opens and follows and conv != piece.conv
                    yield piece
                opens = follows and conv != piece.conv
                piece = Piece(conv, seq)
            piece.add(turn, initial, fault)
            seen = seq
    if piece is not None:
        yield piece


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows():
        for p in pieces(batches):
            text = "".join(p.rows)
            out = {"conv_id": p.conv, "first": p.first, "rows": text, "whole": p.whole, "first_role": p.first_role, "last_role": p.last_role, "low": p.low, "high": p.high, **p.counts}
            if p.whole:
                out["cost"], out["edits"] = cheapest(text)
            else:
                out["crossings"] = [dict(zip(("entry", "end", "cost", "edits"), c)) for c in crossings(text)]
            yield out

    return _batches(rows(), schema, 500)


def _join_pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Settled pieces, and after the last of a conversation a row with its report."""

    def settled(found, audit: list[str], at: int):
        for piece, entry, edits in found:
            yield {"conv_id": piece["conv_id"], "first": piece["first"], "rows": piece["rows"], "entry": entry, "edits": edits, "position": at}
            audit.append(edits)
            at += len(edits) - edits.count("D")
        return at

    def close(joined: Joined, total: dict, audit: list[str], at: int):
        cost = min(c for s, (c, _) in joined.live.items() if s in _ACCEPTING)
        yield from settled(joined.close(), audit, at)
        gaps = _gaps(total["low"], total["high"], total["turns"])
        yield {"conv_id": total["conv_id"], "gaps": gaps, **{c: total[c] for c in _COUNTS[:4]}, "cost": cost, "audit": "".join(audit)}

    def rows():
        total = None
        for p in _rows(batches):
            if total is None or p["conv_id"] != total["conv_id"]:
                if total is not None:
                    yield from close(joined, total, audit, at)
                joined, total, audit, at = Joined(), dict(p), [], 0
            else:
                for c in _COUNTS:
                    total[c] += p[c]
                total["illegal"] += total["last_role"] + p["first_role"] not in _LEGAL
                total["turns"] -= total["high"] is not None and total["high"] == p["low"]
                total["last_role"] = p["last_role"]
                total["low"] = p["low"] if total["low"] is None else total["low"]
                total["high"] = total["high"] if p["high"] is None else p["high"]
            table = [(c["entry"], c["end"], c["cost"], c["edits"]) for c in p["crossings"]]
            at = yield from settled(joined.add(p, table), audit, at)
        if total is not None:
            yield from close(joined, total, audit, at)

    return _batches(rows(), schema)


def _edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each turn that a settled piece lays down."""

    def rows():
        for p in _rows(batches):
            at = p["position"]
            for i, edit, role in applied(p["rows"], p["edits"], p["entry"])[0]:
                if edit != "D":
                    yield {"conv_id": p["conv_id"], "position": at, "seq": None if i is None else p["first"] + i, "edit": edit, "new_role": role}
                    at += 1

    return _batches(rows(), schema)


def _digested(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows():
        conv, digest = None, None
        for r in _rows(batches):
            line = f"{r['role']}:{r['text']}".encode()
            if digest is None or r["conv_id"] != conv:
                if digest is not None:
                    yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}
                conv, digest = r["conv_id"], hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        if digest is not None:
            yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}

    return _batches(rows(), schema)


# -- over Spark


def _mapped(df: DataFrame, run, ddl: str) -> DataFrame:
    """df through run(batches, schema), whose conv_id has df's type."""
    ddl = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {ddl}"
    workspace.ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: run(batches, schema), ddl)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: made faulty by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its marks, 3 repeats it, 4 makes it a user's.
    A null is one space in that key, as role and as text.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    rows = turns.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), kind.alias("_k")).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", _MARKS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_k") == 3, 2).otherwise(1).alias("_k"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_k"))).alias("_k")).drop("_k")


def _fault(text: Column) -> Column:
    body = F.rtrim(text, F.lit(_SPACE))
    return F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(*_MARKS), "truncated")


def _sorted(turns: DataFrame) -> DataFrame:
    """The rows in order, numbered by seq, which goes up by one within a partition."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.select("*", F.left("text", F.lit(64)).alias("_start"), F.xxhash64("text").alias("_hash"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "_start", "_hash", "_n"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq"), F.left("role", F.lit(1)).alias("initial"), _fault(F.col("text")).alias("fault"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _light(rows: DataFrame) -> DataFrame:
    """conv_id, turn, seq, initial, fault, in blocks of neighbouring rows; repeats of a role and text are found by their SHA-256."""
    firsts = rows.filter("fault is null or fault <> 'blank'").groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    fault = F.when(F.col("fault").eqNullSafe("blank"), "blank").when(F.col("seq") > F.col("_first"), "duplicate").otherwise(F.col("fault"))
    marked = rows.select("conv_id", "turn", "seq", "initial", "role", "digest", "fault").join(firsts, same, "left").select("conv_id", "turn", "seq", "initial", fault.alias("fault"))
    return marked.repartition(F.floor(F.col("seq") / BLOCK)).sortWithinPartitions("seq")


class Repair:
    """What was found and what is left.

    ``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, a row for each conversation that has rows.
    ``turns``: conv_id, position, edit, role, text, a row for each turn after the edits.
    """

    def __init__(self, report: DataFrame, turns: DataFrame):
        self.report, self.turns = report, turns


def repair_turns(turns: DataFrame) -> Repair:
    """Finds faults in conv_id, turn, role, text and mends each conversation most cheaply.

    Rows go by turn, null first; those of one turn by role, the first 64 characters of
    their text and its hash, so repeats are neighbours.  A row's first fault counts: blank,
    duplicate (role and text of an earlier row), truncated.  Blank rows and duplicates are
    deleted, truncated ones that stay cost more.  A null text is empty and so blank; a null
    or empty role has no first letter, so such a row can't be kept under its role.  A null
    conv_id is a conversation of its own.  Equally cheap repairs: the least audit in ASCII.
    No rows give no report and no turns; other columns are ignored.
    """
    rows = workspace.Table(_sorted(turns), "turns").df
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    ddl = f"first long, rows string, whole boolean, first_role string, last_role string, low long, high long, {counts}, cost long, edits string, crossings array<struct<entry: int, end: int, cost: long, edits: string>>"
    found = workspace.Table(_mapped(_light(rows), _pieces, ddl), "pieces").df
    whole, parts = found.filter("whole"), found.filter("not whole")
    ddl = "first long, rows string, entry int, edits string, position long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    joined = workspace.Table(_mapped(parts.repartition("conv_id").sortWithinPartitions("conv_id", "first"), _join_pieces, ddl), "joined").df
    columns = ["conv_id", "gaps", *_COUNTS[:4], "cost", "audit"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    report = whole.select("conv_id", gaps, *_COUNTS[:4], "cost", F.col("edits").alias("audit")).unionByName(joined.filter("audit is not null").select(*columns))
    settled = whole.select("conv_id", "first", "rows", F.lit(START).alias("entry"), "edits", F.lit(0).cast("long").alias("position")).unionByName(joined.filter("audit is null").select("conv_id", "first", "rows", "entry", "edits", "position"))
    edits = _mapped(settled, _edited, "position long, seq long, edit string, new_role string")
    texts = rows.select("seq", "role", "text")
    # every kept row has its own number, so no key is common
    stay = edits.filter("seq is not null").join(texts, "seq").select("conv_id", "position", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    new = edits.filter("seq is null").select("conv_id", "position", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repair(report, stay.unionByName(new))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the lines ``role:text`` of each conversation by position.

    The digest is one chain over a conversation's texts; they pass through a task as a
    stream and aren't held.
    """
    rows = turns.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return _mapped(rows, _digested, "repaired_sha256 string")
