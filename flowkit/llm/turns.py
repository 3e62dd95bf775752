"""Conversation structure repair: cheapest edits that give the roles `(s?(ua)+)?`, by a streamed DP.

Every turn is kept (free), given the role user or assistant (3) or deleted (4); turns without text
may be inserted (3). Blank turns and repetitions of an earlier turn must be deleted; a truncated
turn that stays costs 3 more. Of equally cheap scripts the one whose edits (D, I, K, R) come first
in ASCII order wins.

The best way on from a turn depends only on the role reached before it: nothing yet, system, user or
assistant. Turns are dealt by conversation and sorted backwards, and `mapInArrow` carries the four
costs from batch to batch. Costs less their minimum take few values, so the DP is a small automaton
that leaves one byte per turn: the best edit from each of the four roles. The bytes leave in
chunks, so a conversation of any length needs memory for one chunk. A second stream in forward
order meets the chunks just before their turns, follows them and writes the edits. Earlier
repetitions are found by a sort within the conversation, not by a set of turns. One conversation
is one task, a stream that Spark sorts on disk: its repaired text has to be hashed in order.

Order: by turn, nulls first; equal turns by role, then by the MD5 of role and text. Roles count by
their first letter; a null or other role can be reroled or deleted, not kept. Null roles and texts
count as one space (a blank turn). Conversations with a null id are one conversation. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.llm.common import tidy

CHUNK = 1 << 16  # turns whose backpointers leave together
SPACES = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, STAYS_CUT = 0, 3, 4, 3, 3

# Roles reached: nothing, system, user, assistant. The role that may follow each, user before assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FAULTS = (None, "blank", "duplicate", "truncated")
EDITS = "DIKR"
_ENDS = (0, 2 * INSERT, INSERT, 0)


def _insertable(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kept(state: int, role: int) -> int | None:
    """Role reached by keeping a turn: role 0 system, 1 user, 2 assistant, 3 other."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


class Automaton:
    """DP steps on (costs less their minimum, turn code), worked out once each."""

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: list[list[tuple[int, int] | None]] = []
        self.end = self.state(_ENDS)

    def state(self, costs: tuple[int, ...]) -> int:
        low = min(costs)
        costs = tuple(c - low for c in costs)
        if costs not in self.number:
            self.number[costs] = len(self.costs)
            self.costs.append(costs)
            self.steps.append([None] * 16)
        return self.number[costs]

    def step(self, state: int, code: int) -> tuple[int, int]:
        """(state before the turn, its four best edits in two bits each)."""
        known = self.steps[state][code]
        if known is None:
            known = self.steps[state][code] = self._work_out(self.costs[state], code)
        return known

    def _work_out(self, later: tuple[int, ...], code: int) -> tuple[int, int]:
        role, fault = code >> 2, FAULTS[code & 3]
        best = []
        for q in range(4):
            ways = [(later[q] + DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                extra = STAYS_CUT if fault == "truncated" else 0
                to = _kept(q, role)
                if to is not None:
                    ways.append((later[to] + KEEP + extra, "K"))
                ways.append((later[_insertable(q)] + REROLE + extra, "R"))
            best.append(min(ways))
        for _ in range(2):  # an insertion is followed by the best edit from the role it reaches
            best = [min(best[q], (best[_insertable(q)][0] + INSERT, "I")) for q in range(4)]
        pointers = sum(EDITS.index(edit) << 2 * q for q, (_, edit) in enumerate(best))
        return self.state(tuple(c for c, _ in best)), pointers


def _filled(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def _prepared(turns: DataFrame, lost: str | None) -> DataFrame:
    """conv_id, turn, role, text, digest, lost."""
    return turns.select(
        "conv_id", "turn", _filled(F.col("role")).alias("role"), _filled(F.col("text")).alias("text"),
        (F.col(lost) if lost else F.lit(False)).alias("lost"),
    ).withColumn("digest", F.unhex(F.md5(F.concat_ws("\0", "role", "text").cast("binary"))))


def _codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, code: the turn's role in bits 2 and 3, its first fault below."""
    end = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    light = rows.where(~F.col("lost")).select(
        "conv_id", "turn", "role", "digest", (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
    ).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(F.col("blank"), 1).when(F.row_number().over(seen) > 1, 2).when(F.col("cut"), 3).otherwise(0)
    )
    return light.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "digest", (F.col("kind") * 4 + F.col("fault")).cast("tinyint").alias("code"))


def _pointer_chunks(codes: DataFrame, chunk: int) -> DataFrame:
    """Backpointers and codes of up to `chunk` turns in forward order, under the key of their first turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton()
        conv, first_batch, state, number = None, True, machine.end, 0
        pointers, held, key = bytearray(), bytearray(), None
        types: list[pa.DataType] = []
        for batch in batches:
            out: list[tuple] = []
            types = batch.schema.types[:4]
            convs, kinds = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            turns, roles, digests = batch.column(1), batch.column(2), batch.column(3)
            for k, (own, code) in enumerate(zip(convs, kinds)):
                fresh = first_batch or own != conv
                if pointers and (fresh or len(pointers) >= chunk):
                    if key is None:
                        key = (turns[k - 1].as_py(), roles[k - 1].as_py(), digests[k - 1].as_py())
                    out.append((conv, *key, number, bytes(pointers[::-1]), bytes(held[::-1])))
                    pointers.clear()
                    held.clear()
                    number += 1
                if fresh:
                    conv, state, number, first_batch = own, machine.end, 0, False
                state, byte = machine.step(state, code)
                pointers.append(byte)
                held.append(code)
                key = None
            if len(batch):
                key = (turns[-1].as_py(), roles[-1].as_py(), digests[-1].as_py())
            if out:
                yield _chunk_batch(out, types)
        if pointers:
            yield _chunk_batch([(conv, *key, number, bytes(pointers[::-1]), bytes(held[::-1]))], types)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields[:4])
    backwards = codes.sortWithinPartitions(
        "conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"),
        F.desc(F.col("code") % 4 == FAULTS.index("duplicate")))  # of equal turns, the first one counts
    return backwards.mapInArrow(tidy(run), ddl + ", chunk int, pointers binary, codes binary")


def _chunk_batch(rows: list[tuple], key_types: list[pa.DataType]) -> pa.RecordBatch:
    types = [*key_types, pa.int32(), pa.binary(), pa.binary()]
    return pa.record_batch(
        [pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
        ["conv_id", "turn", "role", "digest", "chunk", "pointers", "codes"])


def repair(turns: DataFrame, lost: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The edit script of every conversation, in order within one partition.

    Columns: conv_id, position long (from 0), edit string (K, R, D, I), fault string (null, blank,
    duplicate, truncated), turn and role_before (null for insertions), role and text (null for
    deletions). `lost` may name a boolean column of rows that only keep their conversation in the
    result; one without other rows has a single row whose edit is null.
    """
    rows = _prepared(turns, lost)
    chunks = _pointer_chunks(_codes(rows), chunk)
    text_rows = rows.select(
        "conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text", "lost",
        F.lit(0).alias("chunk"), F.lit(None).cast("binary").alias("pointers"), F.lit(None).cast("binary").alias("codes"))
    both = text_rows.unionByName(chunks.select(
        "conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"),
        F.lit(False).alias("lost"), "chunk", "pointers", "codes"))
    forwards = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "digest", "kind", F.desc("chunk"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = (f"conv_id {types['conv_id']}, position long, edit string, fault string, turn {types['turn']}, "
           "role_before string, role string, text string")
    return forwards.select(
        "conv_id", "turn", "role", "text", "kind", "lost", "pointers", "codes").mapInArrow(tidy(_follow), ddl)


class _Script:
    """Output rows of one batch; indices point into the batch."""

    def __init__(self) -> None:
        self.conv, self.row, self.position, self.edit, self.fault, self.role = [], [], [], [], [], []

    def add(self, conv: int, row: int | None, position: int, edit: str | None, fault: str | None, role: str | None) -> None:
        self.conv.append(conv)
        self.row.append(row)
        self.position.append(position)
        self.edit.append(edit)
        self.fault.append(fault)
        self.role.append(role)

    def batch(self, convs: pa.Array, turns: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        row, string = pa.array(self.row, pa.int64()), pa.string()
        edit = pa.array(self.edit, string)
        before = roles.take(row)
        role = pc.if_else(pc.equal(edit, "K"), before, pa.array(self.role, string))
        text = pc.if_else(pc.equal(edit, "I"), "", texts.take(row))
        gone = pc.or_kleene(pc.equal(edit, "D"), pc.is_null(edit))
        text = pc.if_else(gone, pa.scalar(None, string), text)
        return pa.record_batch(
            [convs.take(pa.array(self.conv, pa.int64())), pa.array(self.position, pa.int64()), edit,
             pa.array(self.fault, string), turns.take(row), before, role, text],
            ["conv_id", "position", "edit", "fault", "turn", "role_before", "role", "text"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the backpointers through sorted chunks and turns of whole conversations."""
    names = {USER: "user", ASSISTANT: "assistant"}
    conv, begun, state, position, any_turn = None, False, START, 0, False
    pending: list[tuple[bytes, bytes]] = []
    at = 0

    def close(out: _Script, at_conv: int) -> None:
        nonlocal state, position
        if not any_turn:
            out.add(at_conv, None, 0, None, None, None)
        while _ENDS[state]:
            state = _insertable(state)
            out.add(at_conv, None, position, "I", None, names[state])
            position += 1

    previous = None  # last conversation id of the batch before, as an array of one
    for batch in batches:
        convs, turns, roles, texts = batch.column(0), batch.column(1), batch.column(2), batch.column(3)
        if previous is not None:  # row 0 stands for the conversation that is still open
            convs = pa.concat_arrays([previous, convs])
        offset = len(convs) - len(batch)
        out = _Script()
        kinds, losts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        pointers, codes = batch.column(6), batch.column(7)
        ids = batch.column(0).to_pylist()
        for k, own in enumerate(ids):
            if not begun or own != conv:
                if begun:
                    close(out, k + offset - 1)
                conv, begun, state, position, any_turn, at = own, True, START, 0, False, 0
                pending.clear()
            if kinds[k] == 0:
                pending.append((pointers[k].as_py(), codes[k].as_py()))
                continue
            if losts[k]:
                continue
            any_turn = True
            if at == len(pending[0][0]):
                pending.pop(0)
                at = 0
            byte, code = pending[0][0][at], pending[0][1][at]
            at += 1
            while True:
                edit = EDITS[byte >> 2 * state & 3]
                if edit != "I":
                    break
                state = _insertable(state)
                out.add(k + offset, None, position, "I", None, names[state])
                position += 1
            role = None
            if edit == "K":
                state = _kept(state, code >> 2)
            elif edit == "R":
                state = _insertable(state)
                role = names[state]
            out.add(k + offset, k, position, edit, FAULTS[code & 3], role)
            position += 1
        if len(batch):
            previous = convs.slice(len(convs) - 1, 1)
            yield out.batch(convs, turns, roles, texts)
    if begun:
        out = _Script()
        close(out, 0)
        if out.conv:
            none = pa.nulls(0, turns.type), pa.nulls(0, roles.type), pa.nulls(0, texts.type)
            yield out.batch(previous, *none)


# ---- the damaged table and its report -----------------------------------------------------------

def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults set by the CRC-32 of `conv_id:turn`, and `lost` for those dropped."""
    role, text = _filled(F.col("role")), _filled(F.col("text"))
    key = F.concat(_filled(F.col("conv_id")), F.lit(":"), _filled(F.col("turn")))
    fault = F.crc32(key.cast("binary")) % 20
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault == 0).alias("lost"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def report(script: DataFrame) -> DataFrame:
    """One row per conversation of an edit script as `repair` returns it (whole, in order, unshuffled).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        n = dict.fromkeys(counts, 0)
        audit, digest, any_turn, initial = bytearray(), hashlib.sha256(), False, None
        low = high = None
        distinct = 0

        def row(of: pa.Array) -> tuple:
            n["gaps"] = high - low + 1 - distinct if distinct else 0
            return of, [n[c] for c in counts], audit.decode(), digest.hexdigest()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.concat_arrays([r[0] for r in rows]), *[pa.array([r[1][c] for r in rows], pa.int64()) for c in range(6)],
                 pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
                ["conv_id", *counts, "audit", "repaired_sha256"])

        previous = None
        for batch in batches:
            ids, out = batch.column(0), []
            columns = [c.to_pylist() for c in batch.columns]
            for k, (own, _, edit, fault, turn, before, role, text) in enumerate(zip(*columns)):
                if not begun or own != conv:
                    if begun:
                        out.append(row(ids.slice(k - 1, 1) if k else previous))
                    conv, begun, n = own, True, dict.fromkeys(counts, 0)
                    audit, digest, any_turn, initial = bytearray(), hashlib.sha256(), False, None
                    low = high = None
                    distinct = 0
                if edit is None:
                    continue
                audit += edit.encode()
                n["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if fault:
                    n[fault] += 1
                    n["cost"] += STAYS_CUT if fault == "truncated" and edit != "D" else 0
                if edit != "I":
                    if initial is not None and initial + before[:1] not in legal:
                        n["illegal"] += 1
                    initial = before[:1]
                    if turn is not None and turn != high:
                        low, high, distinct = turn if low is None else low, turn, distinct + 1
                if edit != "D":
                    digest.update(("\n" if any_turn else "").encode() + f"{role}:{text}".encode())
                    any_turn = True
            if len(batch):
                previous = ids.slice(len(batch) - 1, 1)
            if out:
                yield batch_of(out)
        if begun:
            yield batch_of([row(previous)])

    kind = script.schema["conv_id"].dataType.simpleString()
    return script.mapInArrow(
        tidy(run), f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def repair_report(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damage the turns, repair them and report every original conversation."""
    return report(repair(damage(turns), "lost", chunk))
