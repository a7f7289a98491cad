"""Operator 11: cheapest repair of the turn structure of conversations.

A row is kept (0), given the role user or assistant (3) or deleted (4); blank rows and repeats must be deleted,
truncated ones cost 3 more unless deleted, and empty user or assistant turns may be inserted (3), so that the
initials of the roles are ``(s?(ua)+)?``. Of the cheapest edits the audit that sorts first is taken (D, I, K, R).

A row is one code: its role's initial and its fault. Conversations are put in buckets by length, and a bucket is a tensor of
codes with time first: costs to go of all its conversations and states are updated turn by turn from the end, stored, and
then all are traced together from the beginning, one letter a step.

Scale: repeats of a row are counted before any shuffle; whether a text was said before is told by a window
over conversation, role and text, not over the conversation. One shuffle brings rows together by conversation, in order, and tasks read
them as a stream. A conversation of more than ``long_rows`` rows or ``long_bytes`` of text gives up its texts: only
its codes are kept (a byte a row), the costs are updated in stretches of ``long_rows`` turns with only the costs between
them stored, and its texts are read a second time as a stream that is hashed. A hash over one conversation's text is sequential,
so a single conversation passes through one task; what that task holds are two bytes a row.

Defined results: a null conversation, turn, role or text is one space in the key of the damage, null roles and texts are one space
everywhere; rows without ``conv_id`` are one conversation. Rows of one turn are ordered by role, then text; rows without a turn come first. Repeated
rows are repeats. Very long texts are read whole. Conversations whose rows are all dropped keep a row; an empty table gives none. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, small_batches, table

WHITE = " \t\n\x0b\x0c\r"
LONG_ROWS, LONG_BYTES = 4_096, 8 << 20

# States: nothing yet, after system, after user, after assistant. Codes: initial (0 other, 1 s, 2 u, 3 a) + 4 * fault.
START, SYSTEM, USER, ASSISTANT = range(4)
SOUND, BLANK, REPEAT, TRUNCATED, NO_ROW = range(5)
NEXT = np.array([USER, USER, ASSISTANT, USER])
NAMES = ["", "system", "user", "assistant"]
NEVER = 1 << 40
#: The state after keeping a row, by state and initial; -1: not allowed.
KEPT = np.full((4, 4), -1)
KEPT[START, SYSTEM], KEPT[START, USER], KEPT[SYSTEM, USER], KEPT[USER, ASSISTANT], KEPT[ASSISTANT, USER] = SYSTEM, USER, USER, ASSISTANT, USER
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3


# --- rows and their faults ---------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after the damage, ``n`` copies of each (0: dropped)."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fate.alias("fate")).select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, code): distinct rows, and the code of the first copy of each. A dropped row is a row without text and copies."""
    there = F.col("n") > 0
    own = rows.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "n")
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    said = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = (
        F.when(F.col("n") == 0, NO_ROW).when(end == "", BLANK).when(F.col("before") > 1, REPEAT).when(end.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    )
    return own.withColumn("before", F.row_number().over(said)).select(
        "conv_id", "turn", "role", "text", "n", (F.coalesce(initial(F.col("role")), F.lit(0)) + 4 * fault).cast("int").alias("code")
    )


def initial(role: Column) -> Column:
    return F.instr(F.lit("sua"), F.substring(role, 1, 1)) * F.when(role == "", 0).otherwise(1)


def copies(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The codes of all copies: those after the first are repeats, or blank like it."""
    out = np.repeat(codes, n).astype(np.uint8)
    later = np.ones(len(out), bool)
    later[(np.cumsum(n) - n)[n > 0]] = False
    again = later & (out // 4 != BLANK)
    out[again] = out[again] % 4 + 4 * REPEAT
    return out


# --- costs and edits ---------------------------------------------------------------------------------


def relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs with turns inserted first, for (conversations, 4)."""
    user = np.minimum(cost[:, USER], INSERT + cost[:, ASSISTANT])
    assistant = np.minimum(cost[:, ASSISTANT], INSERT + cost[:, USER])
    return np.stack([np.minimum(cost[:, START], INSERT + user), np.minimum(cost[:, SYSTEM], INSERT + user), user, assistant], axis=1)


def final_costs(n: int) -> np.ndarray:
    return relaxed(np.tile(np.array([0, NEVER, NEVER, 0]), (n, 1)))


def costs_to_go(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(turns + 1, conversations, 4) for time-major ``codes``; ``last`` are the costs after the last turn."""
    out = np.empty((len(codes) + 1, *last.shape), np.int64)
    out[-1] = last
    for t in range(len(codes) - 1, -1, -1):
        after, first, fault = out[t + 1], codes[t] % 4, codes[t] // 4
        cost = DELETE + after
        live = (fault == SOUND) | (fault == TRUNCATED)
        more = np.where(fault == TRUNCATED, CUT_SHORT, 0)
        for s in range(4):
            to = KEPT[s][first]
            keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0)[:, None], 1)[:, 0], NEVER)
            best = more + np.minimum(keep, REROLE + after[:, NEXT[s]])
            cost[:, s] = np.where(live, np.minimum(cost[:, s], best), cost[:, s])
        cost = relaxed(cost)
        absent = fault == NO_ROW
        cost[absent] = after[absent]
        out[t] = cost
    return out


def trace(codes: np.ndarray, cost: np.ndarray, sizes: np.ndarray, state: np.ndarray, at_end: bool) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Letters and states after them, one array a step (letter 0: none), and the last states. ``at_end``: these turns are the last ones."""
    who, at, letters, states = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), [], []
    while True:
        here, over = cost[at, who, state], at >= sizes
        busy = ~over | (at_end & (here > 0))
        if not busy.any():
            return letters, states, state
        code = codes[np.minimum(at, len(codes) - 1), who] if len(codes) else np.zeros(len(sizes), np.uint8)
        first, fault = code % 4, code // 4
        after = cost[np.minimum(at + 1, len(codes)), who]
        kept = KEPT[state, first]
        more = np.where(fault == TRUNCATED, CUT_SHORT, 0)
        live = ~over & ((fault == SOUND) | (fault == TRUNCATED))
        delete = ~over & (DELETE + after[who, state] == here)
        insert = INSERT + cost[at, who, NEXT[state]] == here
        keep = live & (kept >= 0) & (more + after[who, np.maximum(kept, 0)] == here)
        choice = np.select([~busy, delete, insert, keep], [0, 68, 73, 75], 82)  # the letters D, I, K and R
        state = np.select([(choice == 73) | (choice == 82), choice == 75], [NEXT[state], kept], state)
        at = at + (busy & (choice != 73))
        letters.append(choice.astype(np.uint8))
        states.append(state.astype(np.uint8))


def repair_bucket(codes: list[np.ndarray]) -> list[tuple[int, bytes, bytes]]:
    """Cost, letters and states after each letter, for conversations of about one length."""
    sizes = np.array([len(c) for c in codes])
    tensor = np.full((int(sizes.max()), len(codes)), 4 * NO_ROW, np.uint8)
    for i, c in enumerate(codes):
        tensor[: len(c), i] = c
    cost = costs_to_go(tensor, final_costs(len(codes)))
    letters, states, _ = trace(tensor, cost, sizes, np.zeros(len(codes), np.int64), True)
    letters, states = (np.array(x, np.uint8).reshape(len(x), len(codes)).T for x in (letters, states))
    return [(int(cost[0, i, START]), own[own > 0].tobytes(), states[i][own > 0].tobytes()) for i, own in enumerate(letters)]


def repair_long(codes: np.ndarray, stretch: int) -> tuple[int, bytes, bytes]:
    """``repair_bucket`` of one conversation; costs are stored between stretches and computed again inside them."""
    starts = range(0, max(1, len(codes)), stretch)
    last = {len(starts): final_costs(1)}
    for i in reversed(starts):
        last[i // stretch] = costs_to_go(codes[i : i + stretch, None], last[i // stretch + 1])[0]
    state, letters, states = np.array([START]), [], []
    for i in starts:
        own = codes[i : i + stretch, None]
        got, after, state = trace(own, costs_to_go(own, last[i // stretch + 1]), np.array([len(own)]), state, i == starts[-1])
        letters += [x.tobytes() for x in got]
        states += [x.tobytes() for x in after]
    return int(last[0][0, START]), b"".join(letters), b"".join(states)


def repaired_lines(letters: bytes, states: bytes, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines ``role:text`` after the edits; ``rows`` are those that letters other than I take up."""
    for letter, state in zip(letters, states, strict=True):
        if letter == 73:
            yield f"{NAMES[state]}:"
            continue
        role, text = next(rows)
        if letter != 68:
            yield f"{role if letter == 75 else NAMES[state]}:{text}"


# --- conversations in tasks --------------------------------------------------------------------------


class Conversation:
    """What a task knows of a conversation whose rows it reads."""

    def __init__(self, key: str | None) -> None:
        self.key, self.codes, self.rows, self.n_rows, self.bytes = key, [], [], 0, 0
        self.least = self.most = None
        self.turns = 0

    def add(self, turn: np.ndarray, known: np.ndarray, role: list[str], text: list[str], n: np.ndarray, code: np.ndarray, long_rows: int, long_bytes: int) -> None:
        self.codes.append(copies(code, n))
        self.n_rows += int(n.sum())
        turn = turn[known & (n > 0)]
        if len(turn):
            self.turns += int((np.diff(turn) != 0).sum()) + int(self.most is None or self.most != turn[0])
            self.least, self.most = int(turn[0]) if self.least is None else self.least, int(turn[-1])
        if self.rows is not None:
            self.rows += [(r, t, int(k)) for r, t, k in zip(role, text, n, strict=True) if k]
            self.bytes += sum(len(t) for t, k in zip(text, n, strict=True) if k)
            if self.n_rows > long_rows or self.bytes > long_bytes:
                self.rows = None

    def all_codes(self) -> np.ndarray:
        return np.concatenate(self.codes)

    def told(self, codes: np.ndarray, cost: int, letters: bytes, states: bytes) -> tuple:
        fault, first = codes // 4, (codes % 4).astype(np.int64)
        legal = np.isin(first[:-1] * 4 + first[1:], [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        sha = None
        if self.rows is not None:
            rows = ((r, t) for r, t, n in self.rows for _ in range(n))
            sha = hashlib.sha256("\n".join(repaired_lines(letters, states, rows)).encode("utf-8", "surrogatepass")).hexdigest()
        counts = [int((fault == f).sum()) for f in (BLANK, REPEAT, TRUNCATED)]
        return (self.key, gaps, *counts, int(len(legal) - legal.sum()), cost, letters.decode(), sha, None if sha else states)


OUT = pa.schema(
    [("conv_key", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("states", pa.binary())]
)
OUT_DDL = "conv_key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, states binary"


def finished(ready: list[Conversation], long_rows: int) -> pa.RecordBatch:
    """Rows of conversations that are read to the end: tensors of those whose lengths round up to one power of two."""
    buckets: dict[int, list[int]] = defaultdict(list)
    codes, got = [c.all_codes() for c in ready], {}
    for i, c in enumerate(codes):
        if len(c) > long_rows:
            got[i] = repair_long(c, long_rows)
        else:
            buckets[max(0, len(c) - 1).bit_length()].append(i)
    for own in buckets.values():
        got |= dict(zip(own, repair_bucket([codes[i] for i in own]), strict=True))
    rows = [c.told(codes[i], *got[i]) for i, c in enumerate(ready)]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)


def runs(keys: pa.Array) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def repair_stream(long_rows: int, long_bytes: int, at_once: int = 1 << 16) -> Callable:
    """Rows in order of conversation to one row per conversation."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ready, held = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n, code = batch["conv_key"], batch["n"].to_numpy(), batch["code"].to_numpy()
            known = ~np.asarray(batch["turn"].is_null())
            turn = batch["turn"].fill_null(0).to_numpy()
            for a, b in runs(keys):
                key = keys[a].as_py()
                if own is None or own.key != key:
                    if own is not None:
                        ready.append(own)
                        held += own.n_rows + own.bytes // 64
                    if held > at_once:
                        yield finished(ready, long_rows)
                        ready, held = [], 0
                    own = Conversation(key)
                span = slice(a, b)
                own.add(turn[span], known[span], batch["role"][span].to_pylist(), batch["text"][span].to_pylist(), n[span], code[span], long_rows, long_bytes)
        if own is not None:
            yield finished([*ready, own], long_rows)

    return one


def hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_key, audit, states, role, text, n), the edits before the rows of each conversation, to the hash of the repaired rows."""
    key, edits, digest, first = None, None, hashlib.sha256(), True

    def say(lines: Iterator[str]) -> None:
        nonlocal first
        for line in lines:
            digest.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
            first = False

    def row() -> pa.RecordBatch:
        say(repaired_lines(*edits, iter(())))
        return pa.RecordBatch.from_pydict({"conv_key": pa.array([key], pa.string()), "repaired_sha256": pa.array([digest.hexdigest()], pa.string())})

    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("conv_key", "audit", "states", "role", "text", "n"))
        for own, audit, states, role, text, n in zip(*columns, strict=True):
            if audit is not None:
                if edits is not None:
                    yield row()
                key, edits, digest, first, at = own, (audit.encode(), states), hashlib.sha256(), True, 0
                continue
            for _ in range(n):  # letters up to the one that takes up this row
                to = at
                while edits[0][to] == 73:
                    to += 1
                say(repaired_lines(edits[0][at : to + 1], edits[1][at : to + 1], iter([(role, text)])))
                at = to + 1
            if at:
                edits, at = (memoryview(edits[0])[at:], memoryview(edits[1])[at:]), 0
    if edits is not None:
        yield row()


def repair(rows: DataFrame, *, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, n): its faults, the cheapest edits and the hash of the repaired rows."""
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema["conv_id"].dataType
    own = judged(rows).withColumn("conv_key", F.col("conv_id").cast("string")).drop("conv_id")
    own = materialise(own.withColumn("turn", F.col("turn").cast("long")), "repair-rows")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    sorted_rows = own.repartition("conv_key").sortWithinPartitions("conv_key", *order).select("conv_key", "turn", "role", "text", "n", "code")
    told = materialise(sorted_rows.mapInArrow(repair_stream(long_rows, long_bytes), OUT_DDL), "repair-told")
    out = told.where(F.col("repaired_sha256").isNotNull()).drop("states")
    long = told.where(F.col("repaired_sha256").isNull())
    if not long.isEmpty():
        ids = long.select(F.col("conv_key").alias("__key"))
        texts = own.where("n > 0").join(ids, F.col("conv_key").eqNullSafe(F.col("__key")), "left_semi")
        empty = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"))}
        stream = long.select("conv_key", "audit", "states").withColumns(empty).withColumn("what", F.lit(0))
        stream = stream.unionByName(texts.select("conv_key", *empty, F.lit(1).alias("what")), allowMissingColumns=True)
        stream = stream.repartition("conv_key").sortWithinPartitions("conv_key", "what", *order).select("conv_key", "audit", "states", "role", "text", "n")
        hashes = stream.mapInArrow(hash_stream, "conv_key string, repaired_sha256 string").withColumnsRenamed({"conv_key": "__key", "repaired_sha256": "sha"})
        late = long.join(hashes, F.col("conv_key").eqNullSafe(F.col("__key"))).withColumn("repaired_sha256", F.col("sha"))
        out = out.unionByName(late.select(*out.columns))
    return out.select(F.col("conv_key").cast(kind).alias("conv_id"), *[c for c in out.columns if c != "conv_key"])


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damage(table(spark, sf_dir, "conversations")))
