"""Repair of conversations: faults of their turns, and the cheapest edits that make the roles alternate.

Rows of a conversation are read in order by an automaton of four states (nothing yet, after a system turn, after a user
turn, after an assistant turn). A node is a place between two rows in one of the states; edits are arcs between nodes.
A backward pass gives each node its least cost, and arcs that keep to it are optimal. Among optimal paths the audit (one
initial for each edit) of least bytes wins: nodes are ranked by the next 1, 2, 4, ... initials of their best path, with
pointers over as many edits, and the least path is laid out through the doubled pointers.

Conversations are sorted by range, so even a single one is dealt over many tasks. Those that lie within a task are
finished there. Others, and long ones, are cut into chunks: the least costs over a chunk from each state to each are a
small table, and these compose from chunk to chunk.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut, read

#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, LEFT = 3, 4, 3, 3
#: Most rows and characters of a chunk; rows that are worked on together.
ROWS, CHARS, TOGETHER = 1024, 4_000_000, 20_000
#: Characters of a text that help to deal rows of one conversation, turn and role to tasks.
PREFIX = 64
_FAR = 1 << 40
# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; roles: 0 system, 1 user, 2 assistant, 3 others
_NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # state, role -> state
_TURN = np.array([2, 2, 3, 2])  # the state after a turn of the role that is due
_END = np.array([0, 2 * INSERT, INSERT, 0])  # costs of closing from each state
_TAIL = ["", "II", "I", ""]
_DUE = {2: "user", 3: "assistant"}
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)  # 0: no more edits


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of rows (conv_id, turn, role, text): what is left of each, n times (0: dropped)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 0, "").when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("n"))


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n) in order over the tasks, equal ones as one row, with again (role and text were
    there in an earlier turn), tail (last character that isn't blank) and class of the role."""
    same = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("h", F.unhex(F.sha2("text", 256))))
    since = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    often = same.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(F.min(since).alias("since"), F.count("*").alias("m")).where("m > 1").drop("m")
    same = same.join(often, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    role = F.substring("role", 1, 1)
    same = same.select(
        "conv_id", "turn", "role", "text", "n", F.coalesce(F.col("since") < since, F.lit(False)).alias("again"), F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("tail"),
        F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("class"),
    )
    return same.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")


@dataclasses.dataclass
class Rows:
    """Rows of several chunks, one after the other: role class, n, faults; size: rows of each chunk."""

    size: np.ndarray
    role: np.ndarray
    n: np.ndarray
    blank: np.ndarray
    again: np.ndarray
    cut_off: np.ndarray

    @property
    def forced(self) -> np.ndarray:
        return self.blank | self.again

    def offers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row and state: cost of deletion, cost and target of keeping, cost of a new role. Copies go besides."""
        copies, stays = DELETE * (self.n - 1), np.where(self.cut_off & ~self.forced, LEFT, 0) + np.where(self.forced, _FAR, 0)
        goal = _NEXT[:, self.role].T
        keep = np.where(goal < 0, _FAR, 0) + (stays + copies)[:, None]
        return DELETE * self.n, keep, np.maximum(goal, 0), stays + copies + REROLE


def costs(rows: Rows, end: np.ndarray) -> np.ndarray:
    """Least cost of each place (chunk size + 1 of each chunk) and state, when the last place of chunk k costs end[k]."""
    delete, keep, goal, rerole = rows.offers()
    last_row, last = np.cumsum(rows.size) - 1, np.cumsum(rows.size + 1) - 1
    out = np.full((int(last[-1]) + 1 if len(last) else 0, 4), _FAR, np.int64)
    out[last] = end
    order = np.argsort(-rows.size, kind="stable")
    for t in range(int(rows.size.max(initial=0))):
        order = order[rows.size[order] > t]
        r, at = last_row[order] - t, last[order] - t
        after = out[at]
        best = np.minimum(after + delete[r, None], np.take_along_axis(after, goal[r], 1) + keep[r])
        best = np.minimum(best, after[:, _TURN] + rerole[r, None])
        for _ in range(2):  # no path of least cost inserts three turns in one place
            best = np.minimum(best, best[:, _TURN] + INSERT)
        out[at - 1] = np.minimum(best, _FAR)
    return out


def paths(rows: Rows, end: np.ndarray, entry: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The least optimal path of each chunk from state entry[k]: initials, nodes before each edit, and the last state."""
    value = costs(rows, end).ravel()
    places = np.cumsum(rows.size + 1)
    row = np.delete(np.arange(int(places[-1]) if len(places) else 0), places - 1)  # places that a row follows
    delete, keep, goal, rerole = rows.offers()
    state = np.arange(4)
    here = (4 * row[:, None] + state).ravel()
    turn = (4 * row[:, None] + _TURN).ravel()
    arcs = [  # in order of their initials D, I, K, R: cost and target
        (np.repeat(delete, 4), here + 4),
        (np.full(len(here), INSERT), turn),
        (keep.ravel(), (4 * row[:, None] + 4 + goal).ravel()),
        (np.repeat(rerole, 4), turn + 4),
    ]
    target = np.tile(np.arange(len(value)), (4, 1))
    fits = np.zeros((4, len(value)), bool)
    for k, (cost, to) in enumerate(arcs):
        target[k, here] = to
        fits[k, here] = (cost < _FAR) & (cost + value[to] == value[here]) & (value[here] < _FAR)
    # ranks and pointers over the next 1, 2, 4, ... edits; a node without edits ranks first and points to itself
    ends = ~fits.any(axis=0)
    every = np.arange(len(value))
    letter = np.where(ends, 0, fits.argmax(axis=0) + 1)
    jumps = [np.where(ends, every, target[np.maximum(letter - 1, 0), every])]
    rank, steps = letter.astype(np.int64), (~ends).astype(np.int64)
    while not ends[jumps[-1]].all():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jumps[-1]], return_inverse=True)[1]
        # among the arcs of a node the initial decides first, then the rank of what it leads to
        order = np.where(fits, np.arange(1, 5)[:, None] * (int(rank.max()) + 1) + rank[target], np.iinfo(np.int64).max).argmin(axis=0)
        letter = np.where(ends, 0, order + 1)
        steps = steps + steps[jumps[-1]]
        jumps.append(jumps[-1][jumps[-1]])
    start = 4 * (places - rows.size - 1) + entry
    length = steps[start]
    chunk = np.repeat(np.arange(len(start)), length)
    nth = np.arange(len(chunk)) - np.repeat(np.cumsum(length) - length, length)
    node = start[chunk]
    for k, jump in enumerate(jumps):
        node = np.where(nth >> k & 1, jump[node], node)
    final = start.copy()
    for k, jump in enumerate(jumps):
        final = np.where(length >> k & 1, jump[final], final)
    parts = np.cumsum(length)[:-1]
    return np.split(letter[node], parts), np.split(node, parts), final % 4


def written(letters: np.ndarray, nodes: np.ndarray, first: int, place: int, rows: Rows, role: list[str], text: list[str]) -> tuple[str, list[str]]:
    """Audit and repaired lines of a chunk whose rows start at `first` and whose places start at `place`."""
    at, state, lines, more = nodes // 4 - place + first, nodes % 4, [], np.ones(len(letters), np.int64)
    takes = letters != 2
    more[takes] = rows.n[at[takes]]
    out = np.full(int(more.sum()), _LETTERS[1], np.uint8)  # copies of a row are deleted
    out[np.cumsum(more) - more] = _LETTERS[letters]
    for k in np.nonzero(letters > 1)[0]:
        a, due = at[k], _DUE[int(_TURN[state[k]])]
        lines.append(f"{due}:" if letters[k] == 2 else f"{role[a] if letters[k] == 3 else due}:{text[a]}")
    return out.tobytes().decode(), lines


def _closing(state: int) -> list[str]:
    return [f"{r}:" for r in (["user", "assistant"] if state == 1 else ["assistant"] if state == 2 else [])]


def _tally(rows: Rows, turn: list, first: np.ndarray) -> dict[str, np.ndarray]:
    """What is counted of each chunk, and what is needed to count over its borders."""
    total = lambda x: np.array([int(x[a : a + s].sum()) for a, s in zip(first, rows.size, strict=True)], np.int64)
    pair = np.zeros(len(rows.n), np.int64)
    if len(pair):
        pair[1:] = ~_LEGAL[rows.role[:-1], rows.role[1:]]
        pair[first[rows.size > 0]] = 0
    fresh = ~rows.forced
    out = {
        "blank": total(rows.n * rows.blank), "duplicate": total(np.where(rows.blank, 0, rows.n - ~rows.again)), "truncated": total((fresh & rows.cut_off).astype(np.int64)), "illegal": total(pair + rows.n - 1),
        "role_in": [int(rows.role[a]) if s else None for a, s in zip(first, rows.size, strict=True)], "role_out": [int(rows.role[a + s - 1]) if s else None for a, s in zip(first, rows.size, strict=True)],
    }
    known = [[t for t in turn[a : a + s] if t is not None] for a, s in zip(first, rows.size, strict=True)]
    return out | {"turn_in": [k[0] if k else None for k in known], "turn_out": [k[-1] if k else None for k in known], "turns": [len(set(k)) for k in known]}


_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_CHUNK = "part int, no int, role_in int, role_out int, turn_in long, turn_out long, turns long, over array<long>, turn array<long>, role array<string>, text array<string>, class array<int>, n array<long>, again array<boolean>, tail array<string>"


def _rows(size: list[int], role: list[int], n: list[int], again: list[bool], tail: list[str]) -> Rows:
    tail = np.array(tail, object)
    return Rows(np.array(size, np.int64), np.array(role, np.int64), np.array(n, np.int64), tail == "", np.array(again, bool), ~np.isin(tail, [".", "!", "?"]))


def _table(rows: dict[str, list], schema: pa.Schema, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows[f.name]), f.type) if f.name in rows else pa.nulls(size, f.type) for f in schema], schema=schema)


def _repairs(schema: pa.Schema):
    """Sorted rows -> a finished row for each conversation that lies within the task, and chunks of the others."""

    def finish(held: list[tuple]) -> pa.RecordBatch:
        flat = [r for _, rows in held for r in rows]
        turn, role, text, n, again, tail, kind = map(list, zip(*flat, strict=True)) if flat else [[] for _ in range(7)]
        rows = _rows([len(x) for _, x in held], kind, n, again, tail)
        first = np.cumsum(rows.size) - rows.size
        end = np.tile(_END, (len(held), 1))
        cost = costs(rows, end)[first + np.arange(len(held)), 0]
        letters, nodes, last = paths(rows, end, np.zeros(len(held), np.int64))
        audit, digest = [], []
        for k in range(len(held)):
            a, lines = written(letters[k], nodes[k], int(first[k]), int(first[k]) + k, rows, role, text)
            audit.append(a + _TAIL[last[k]])
            digest.append(hashlib.sha256("\n".join(lines + _closing(last[k])).encode()).hexdigest())
        t = _tally(rows, turn, first)
        gaps = [0 if a is None else b - a + 1 - m for a, b, m in zip(t["turn_in"], t["turn_out"], t["turns"], strict=True)]
        out = {"conv_id": [c for c, _ in held], "done": [True] * len(held), "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest} | {c: t[c] for c in ("blank", "duplicate", "truncated", "illegal")}
        return _table(out, schema, len(held))

    def chunk(conv, no: int, rows: list[tuple]) -> pa.RecordBatch:
        turn, role, text, n, again, tail, kind = map(list, zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
        own = _rows([len(rows)], kind, n, again, tail)
        over = np.stack([costs(own, np.where(np.arange(4) == k, 0, _FAR)[None])[0] for k in range(4)], axis=1)
        out = {"conv_id": [conv], "done": [False], "part": [TaskContext.get().partitionId()], "no": [no], "over": [over.ravel()], "turn": [turn], "role": [role], "text": [text], "class": [kind], "n": [n], "again": [again], "tail": [tail]}
        return _table(out | {k: v for k, v in _tally(own, turn, np.zeros(1, np.int64)).items()}, schema, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, many, conv, rows, chars, no, started = [], 0, None, [], 0, 0, False
        inside = False  # whether the conversation began within this task
        for batch in batches:
            for c, *r in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not started or c != conv:
                    if started and inside and not no:
                        ready.append((conv, rows))
                        many += len(rows) + 1
                    elif started:
                        yield chunk(conv, no, rows)
                    inside, started, conv, rows, chars, no = started, True, c, [], 0, 0
                if r[3]:  # dropped rows only show that there is a conversation
                    rows.append(tuple(r))
                    chars += len(r[2])
                if len(rows) >= ROWS or chars >= CHARS:
                    yield chunk(conv, no, rows)
                    rows, chars, no = [], 0, no + 1
                if many > TOGETHER:
                    yield finish(ready)
                    ready, many = [], 0
        if started:
            yield chunk(conv, no, rows)
        if ready:
            yield finish(ready)

    return run


def _onward(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chunks of a conversation in order: what each costs from its last place on, and the counts of them all."""
    pdf = pdf.sort_values(["part", "no"])
    end, ends = _END, []
    for over in reversed(pdf["over"].tolist()):
        ends.append(end)
        end = np.minimum((np.asarray(over).reshape(4, 4) + end).min(axis=1), _FAR)
    used = pdf[pdf["role_in"].notna()]
    known = pdf[pdf["turn_in"].notna()]
    illegal = int(used["illegal"].sum()) + sum(not _LEGAL[int(a), int(b)] for a, b in zip(used["role_out"].tolist()[:-1], used["role_in"].tolist()[1:], strict=True))
    turns = int(known["turns"].sum()) - sum(a == b for a, b in zip(known["turn_out"].tolist()[:-1], known["turn_in"].tolist()[1:], strict=True))
    gaps = int(known["turn_out"].iloc[-1]) - int(known["turn_in"].iloc[0]) + 1 - turns if len(known) else 0
    counts = {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}
    return pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "no": pdf["no"], "at": range(len(pdf)), "end": ends[::-1], "gaps": gaps, "cost": int(end[0]), "illegal": illegal, **counts})


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, state, entry = pdf.sort_values("at"), 0, []
    for leads in pdf["leads"].tolist():
        entry.append(state)
        state = int(leads[state])
    return pd.DataFrame({"conv_id": pdf["conv_id"], "at": pdf["at"], "entry": entry, "closing": [None] * (len(pdf) - 1) + [state]})


def _of(batch: dict[str, list], k: int) -> Rows:
    return _rows([len(batch["n"][k])], batch["class"][k], batch["n"][k], batch["again"][k], batch["tail"][k])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each chunk is left in, for each state it may be entered in."""
    for b in batches:
        x = b.to_pydict()
        leads = [[int(paths(_of(x, k), np.array([x["end"][k]]), np.array([s]))[2][0]) for s in range(4)] for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), pa.array(leads, pa.list_(pa.int32()))], names=["conv_id", "at", "leads"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired lines of each chunk."""
    for b in batches:
        x, audit, lines = b.to_pydict(), [], []
        for k in range(b.num_rows):
            own = _of(x, k)
            letters, nodes, _ = paths(own, np.array([x["end"][k]]), np.array([x["entry"][k]]))
            a, more = written(letters[0], nodes[0], 0, 0, own, x["role"][k], x["text"][k])
            closing = x["closing"][k]
            audit.append(a + ("" if closing is None else _TAIL[closing]))
            lines.append([r.encode() for r in more + ([] if closing is None else _closing(closing))])
        joined = [b"\n".join(r) if r else None for r in lines]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), pa.array(audit, pa.string()), pa.array(joined, pa.binary())], names=["conv_id", "at", "piece", "lines"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> conv_id, audit, repaired_sha256. Lines are hashed as they pass by, so none are held."""
    conv, audit, digest, some, started = None, [], hashlib.sha256(), False, False
    kind = None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])
    for b in batches:
        kind = b.schema.field("conv_id").type
        for c, a, lines in zip(*(b.column(x).to_pylist() for x in ("conv_id", "piece", "lines")), strict=True):
            if started and c != conv:
                yield row()
            if not started or c != conv:
                conv, audit, digest, some, started = c, [], hashlib.sha256(), False, True
            audit.append(a)
            if lines is not None:
                digest.update(b"\n" + lines if some else lines)
                some = True
    if started:
        yield row()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows
    (conv_id, turn, role, text, n), where n says how often a row stands there (0: only its conversation is named).

    Rows without conv_id are one conversation; those without a turn come first. Rows of one turn are ordered by role and
    then by text, both by their bytes. Roles count by their first character; those of another initial than s, u and a
    (null and empty ones too) can't be kept. Turns must be whole numbers. Other columns are not read. An audit is one
    string and a digest runs over all lines in order, so those two alone of what a conversation needs pass one task.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = ordered(rows).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "n", "again", "tail", "class")
    schema = f"conv_id {conv}, done boolean, gaps long, {_COUNTS}, cost long, audit string, repaired_sha256 string, {_CHUNK}"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    all_ = cut(rows.mapInArrow(_repairs(arrow), schema))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    finished = all_.where("done").select(*names)
    left = all_.where("not done")
    small = left.select("conv_id", "part", "no", "over", "role_in", "role_out", "turn_in", "turn_out", "turns", "blank", "duplicate", "truncated", "illegal")
    onward = cut(small.groupBy("conv_id").applyInPandas(_onward, f"conv_id {conv}, part int, no int, at int, end array<long>, gaps long, cost long, illegal long, blank long, duplicate long, truncated long"))
    held = left.select("conv_id", "part", "no", "role", "text", "class", "n", "again", "tail")
    placed = cut(held.join(onward.select("part", "no", "at", "end", F.col("conv_id").alias("c")), ["part", "no"]).where(F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))
    leads = placed.select("conv_id", "at", "class", "n", "again", "tail", "end").mapInArrow(_leads, f"conv_id {conv}, at int, leads array<int>")
    entries = leads.groupBy("conv_id").applyInPandas(_entries, f"conv_id {conv}, at int, entry int, closing int").select(F.col("conv_id").alias("c"), F.col("at").alias("of"), "entry", "closing")
    pieces = placed.join(entries, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("of"))).select("conv_id", "at", "role", "text", "class", "n", "again", "tail", "end", "entry", "closing")
    pieces = pieces.mapInArrow(_pieces, f"conv_id {conv}, at int, piece string, lines binary")
    texts = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_joined, f"conv_id {conv}, audit string, repaired_sha256 string")
    counts = onward.where("at = 0").select(F.col("conv_id").alias("c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return finished.unionByName(counts.join(texts, F.col("c").eqNullSafe(F.col("conv_id"))).select(*names))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read(spark, sf_dir, "conversations")))


# SQL: the same automaton, read forward with the least (cost, audit) of each state; s0 to s3 as in _NEXT
_S = [f"s{k}" for k in range(4)]


def _oracle() -> str:
    best = lambda xs: f"list_min([{', '.join(xs)}])"
    put = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {line}}} END"
    own, line = "r.role || ':' || r.text", lambda x: f"[{x}]"
    keep = {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}
    rows = []
    for goal in range(4):
        ways = [put(f"i.s{goal}", DELETE, "D", "[]::VARCHAR[]")]
        ways += [f"CASE WHEN r.free AND r.i = '{x}' THEN {put(f'i.s{s}', f'{LEFT} * r.cut', 'K', line(own))} END" for s, x in keep.get(goal, [])]
        ways += [f"CASE WHEN r.free THEN {put(f'i.s{s}', f'{REROLE} + {LEFT} * r.cut', 'R', line(repr(_DUE[goal] + ':') + ' || r.text'))} END" for s in {2: [0, 1, 3], 3: [2]}.get(goal, [])]
        rows.append(f"{best(ways)} AS s{goal}")
    insert = lambda t: {0: f"{t}.s0", 1: f"{t}.s1", 2: best([f"{t}.s2", *(put(f"{t}.s{s}", INSERT, "I", "['user:']") for s in (0, 1, 3))]), 3: best([f"{t}.s3", put(f"{t}.s2", INSERT, "I", "['assistant:']")])}
    twice = "SELECT conv_id, pos, " + ", ".join(f"{x} AS s{k}" for k, x in insert("y").items()) + " FROM (SELECT conv_id, pos, " + ", ".join(f"{x} AS s{k}" for k, x in insert("z").items()) + " FROM @ z) y"
    step = "SELECT r.conv_id, r.pos, " + ", ".join(rows) + f" FROM ({twice.replace('@', 'walk')}) i JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id AND r.pos = i.pos + 1"
    nothing = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bit = "CASE WHEN b < 0 THEN xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) ELSE xor(c, b) END"
    return f"""WITH RECURSIVE k AS (SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(flatten(list_transform(bytes, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, b: {bit}, 4294967295::BIGINT), 4294967295) % 20 AS k FROM k),
n AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, right(rtrim(text, {blanks}), 1) AS tail, left(role, 1) AS i FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS was FROM o),
r AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, fault IN ('', 't') AS free, (fault = 't')::INT AS cut FROM f),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {nothing} AS s1, {nothing} AS s2, {nothing} AS s3 FROM conversations UNION ALL {step}),
done AS (SELECT conv_id, {best(['x.s0', 'x.s3'])} AS e FROM ({twice.replace('@', '(SELECT w.* FROM walk w JOIN (SELECT conv_id, max(pos) AS pos FROM walk GROUP BY ALL) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos)')}) x),
c AS (SELECT conv_id, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY ALL)
SELECT done.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  e.c::BIGINT AS cost, e.a AS audit, sha256(array_to_string(e.t, chr(10))) AS repaired_sha256 FROM done LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM done.conv_id"""


ORACLE = _oracle()
