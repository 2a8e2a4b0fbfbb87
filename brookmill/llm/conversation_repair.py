"""Operator 13: repair of conversations by cheapest edits, with Four-Russians block tables.

A conversation is a sequence of symbols: a row's role (system, user, assistant, other),
whether it is cut off, or that it has to go.  Edits keep a row (0), give it the role user or
assistant (2), delete it (3) or insert an empty row (2); an undeleted cut-off row adds 1.  What is
left has to read ``(s?(ua)+)?``, an automaton of four states.

The costs to complete a conversation from each state form a vector.  Less its smallest
entry there are few different vectors, so the step over one symbol is a table of vector and
symbol, and by composition so is the step over ``LENGTH`` symbols.  Blocks are looked up from the
conversation's end to its start; then every block is expanded backward from the vector at
its end, all blocks at once, and traced forward by the least letter (D, I, K, R) that still
leads to the least cost, which gives the least of all cheapest audits.

Rows are ranged by conversation and turn, so a conversation of any size is spread over many
tasks, in fragments bounded in rows and bytes.  One inside a range is repaired where it lies.
Of one that meets a range's border or has several fragments, each fragment becomes a map of
vectors, later of states; these few bytes a fragment are composed along the conversation,
and the fragments are repaired from the vectors and states at their borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, text_slices, written

SPACE = " \t\n\x0b\x0c\r"
#: Symbols of a block.
LENGTH = 4
#: A fragment ends at so many rows or bytes of text.
FRAGMENT_ROWS, FRAGMENT_BYTES = 1 << 16, 8 << 20
#: Bytes of text repaired at a time.
STEP_BYTES = 8 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the role that each state asks for, and that role.
ASKED = (USER, USER, ASSISTANT, USER)
ASKED_ROLE = ("user", "user", "assistant", "user")
#: Costs to complete, and rows to insert, at the end of a conversation.
END_COSTS = (0, 4, 2, 0)
END_INSERTS = (0, 2, 1, 0)
#: Symbols: 2 * role + cut off for the roles s, u, a and others; then two without a role.
MUST_GO, NOTHING, SYMBOLS = 8, 9, 10
KEEPS = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
LEGAL = {"su", "ua", "au"}


class Tables(NamedTuple):
    step: np.ndarray  # (vector, symbol) -> vector before it
    block: np.ndarray  # (vector, block of symbols) -> vector before it
    inserts: np.ndarray  # (vector after, symbol, state before) -> inserts before the row's edit
    letter: np.ndarray  # the row's edit
    state: np.ndarray  # the state after it


def _before(after: tuple[int, ...], symbol: int) -> list[int]:
    """Costs to complete from each state before a row, from those after it."""
    costs = []
    for s in range(4):
        ways = [3 + after[s]]
        if symbol < MUST_GO:
            role, cut = divmod(symbol, 2)
            ways.append(2 + cut + after[ASKED[s]])
            if role in KEEPS[s]:
                ways.append(cut + after[KEEPS[s][role]])
        costs.append(min(ways))
    for _ in range(3):  # inserts run through the states in at most three steps
        costs = [min(c, 2 + costs[ASKED[s]]) for s, c in enumerate(costs)]
    return costs


def _edit(after: tuple[int, ...], before: list[int], symbol: int, state: int) -> tuple[int, str, int]:
    """(inserts, letter, state) of the least edits over one row that keep to the least cost."""
    inserts = 0
    while True:
        if before[state] == 3 + after[state]:
            return inserts, "D", state
        if before[state] == 2 + before[ASKED[state]]:
            inserts, state = inserts + 1, ASKED[state]
            continue
        role, cut = divmod(symbol, 2)
        kept = KEEPS[state].get(role)
        if kept is not None and before[state] == cut + after[kept]:
            return inserts, "K", kept
        return inserts, "R", ASKED[state]


@lru_cache(maxsize=1)
def tables() -> Tables:
    """All tables, from the vectors that can be reached from a conversation's end (number 0)."""
    numbers, rows, at = {END_COSTS: 0}, [], 0
    found = [END_COSTS]
    while at < len(found):
        after, at = found[at], at + 1
        row = []
        for symbol in range(MUST_GO + 1):
            before = _before(after, symbol)
            plain = tuple(c - min(before) for c in before)
            if plain not in numbers:
                numbers[plain] = len(found)
                found.append(plain)
            row.append((numbers[plain], [_edit(after, before, symbol, s) for s in range(4)]))
        rows.append(row)
    n = len(found)
    step = np.tile(np.arange(n)[:, None], SYMBOLS)  # NOTHING leaves all as it is
    inserts, letter = np.zeros((n, SYMBOLS, 4), np.int8), np.zeros((n, SYMBOLS, 4), np.uint8)
    state = np.tile(np.arange(4, dtype=np.int8), (n, SYMBOLS, 1))
    for v, row in enumerate(rows):
        for symbol, (before, edits) in enumerate(row):
            step[v, symbol] = before
            for s, (i, x, to) in enumerate(edits):
                inserts[v, symbol, s], letter[v, symbol, s], state[v, symbol, s] = i, ord(x), to
    block = step
    for _ in range(LENGTH - 1):  # one more symbol in front
        block = np.stack([step[block, symbol] for symbol in range(SYMBOLS)], 1).reshape(n, -1)
    return Tables(step, block.astype(np.int16), inserts, letter, state)


class Blocks:
    """Symbols of several fragments in blocks, each fragment filled up in front."""

    def __init__(self, symbols: list[np.ndarray]):
        self.t = tables()
        counts = np.array([len(s) for s in symbols], np.int64)
        self.n = -(-counts // LENGTH)
        self.first = np.cumsum(self.n) - self.n
        flat = np.full(int(self.n.sum()) * LENGTH, NOTHING, np.uint8)
        for s, a, b in zip(symbols, (self.first * LENGTH).tolist(), self.n.tolist()):
            flat[a + b * LENGTH - len(s) : a + b * LENGTH] = s
        self.symbols = flat.reshape(-1, LENGTH)
        self.codes = self.symbols.astype(np.int64) @ (SYMBOLS ** np.arange(LENGTH - 1, -1, -1))
        self.order = np.argsort(-self.n, kind="stable")  # longest first: those that go on are in front

    def _going_on(self, j: int) -> np.ndarray:
        return self.order[: np.searchsorted(-self.n[self.order], -j)]

    def backward(self, at_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors after each block, vectors before each fragment); ``at_end`` has a row for each fragment."""
        now = at_end.copy()
        after = np.zeros((len(self.codes), *at_end.shape[1:]), np.int16)
        for j in range(int(self.n.max(initial=0))):
            f = self._going_on(j)
            b = self.first[f] + self.n[f] - 1 - j
            after[b] = now[f]
            now[f] = self.t.block[now[f].T, self.codes[b]].T
        return after, now

    def expanded(self, after: np.ndarray) -> np.ndarray:
        """The vector after every symbol, from those after the blocks."""
        out = np.zeros(self.symbols.shape, np.int16)
        if len(out):
            out[:, -1] = after
        for p in range(LENGTH - 2, -1, -1):
            out[:, p] = self.t.step[out[:, p + 1], self.symbols[:, p + 1]]
        return out

    def states(self, vectors: np.ndarray) -> np.ndarray:
        """The state after each block for each of the four states before it."""
        out = np.tile(np.arange(4), (len(vectors), 1))
        for p in range(LENGTH):
            out = self.t.state[vectors[:, p, None], self.symbols[:, p, None], out]
        return out

    def forward(self, through: np.ndarray, at_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states before each block, states after each fragment); ``at_start`` has a row for each fragment."""
        now = at_start.astype(np.int8)
        before = np.zeros((len(self.codes), *now.shape[1:]), np.int8)
        for j in range(int(self.n.max(initial=0))):
            f = self._going_on(j)
            b = self.first[f] + j
            before[b] = now[f]
            now[f] = through[b, now[f].T].T
        return before, now

    def edits(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inserts, letter, state before) of every symbol."""
        states = np.zeros(self.symbols.shape, np.int8)
        now = before
        for p in range(LENGTH):
            states[:, p] = now
            now = self.t.state[vectors[:, p], self.symbols[:, p], now]
        at = (vectors, self.symbols, states)
        return self.t.inserts[at].ravel(), self.t.letter[at].ravel(), states.ravel()

    def rows_of(self, i: int, count: int) -> slice:
        end = int(self.first[i] + self.n[i]) * LENGTH
        return slice(end - count, end)


def symbol_of(role: str, text: str) -> int:
    """The symbol of a row that is no repetition."""
    said = text.rstrip(SPACE)
    if not said:
        return MUST_GO
    return 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (said[-1] not in ".!?")


class Repaired(NamedTuple):
    audit: str
    roles: list[str]
    texts: list[str]
    cost: int


def repair(fragments: list[tuple[np.ndarray, list[str], list[str]]], at_end: list[int] | None = None, at_start: list[int] | None = None, closing: list[bool] | None = None) -> list[Repaired]:
    """Repairs fragments of (symbols, roles, texts), whole conversations unless told otherwise."""
    blocks = Blocks([f[0] for f in fragments])
    after, _ = blocks.backward(np.array(at_end or [0] * len(fragments), np.int16))
    vectors = blocks.expanded(after)
    before, last = blocks.forward(blocks.states(vectors), np.array(at_start or [START] * len(fragments)))
    inserts, letters, states = blocks.edits(vectors, before)
    out = []
    for i, (symbols, roles, texts) in enumerate(fragments):
        rows = blocks.rows_of(i, len(symbols))
        ins, letter, state = inserts[rows], letters[rows], states[rows]
        audit = np.full(len(ins) + int(ins.sum()), ord("I"), np.uint8)
        audit[np.cumsum(ins + 1) - 1] = letter
        more = END_INSERTS[last[i]] if closing is None or closing[i] else 0
        text = audit.tobytes().decode() + "I" * more
        cut = int(((symbols < MUST_GO) & (symbols % 2 == 1) & (letter != ord("D"))).sum())
        cost = 3 * text.count("D") + 2 * (text.count("I") + text.count("R")) + cut
        if text.count("K") == len(text):
            out.append(Repaired(text, roles, texts, cost))
            continue
        new_roles: list[str] = []
        new_texts: list[str] = []
        s = START
        for n, x, s, role, said in zip(ins.tolist(), letter.tolist(), state.tolist(), roles, texts):
            for _ in range(n):
                new_roles.append(ASKED_ROLE[s])
                new_texts.append("")
                s = ASKED[s]
            if x != 68:  # D
                new_roles.append(role if x == 75 else ASKED_ROLE[s])
                new_texts.append(said)
        s = int(last[i])
        for _ in range(more):
            new_roles.append(ASKED_ROLE[s])
            new_texts.append("")
            s = ASKED[s]
        out.append(Repaired(text, new_roles, new_texts, cost))
    return out


FRAGMENTS = (
    "conv_id long, part int, frag int, whole boolean, symbols binary, digests array<binary>, initials string, "
    "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, roles array<string>, texts array<string>, size long"
)
FRAGMENTS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("frag", pa.int32()), ("whole", pa.bool_()), ("symbols", pa.binary()), ("digests", pa.list_(pa.binary())), ("initials", pa.string()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("size", pa.int64()),
])


def _fragment(conv_id: int | None, part: int, frag: int, rows: list[tuple[int | None, str, str]], whole: bool, size: int) -> dict[str, Any]:
    """One row of the fragment table; repetitions are told apart inside the fragment only."""
    symbols, digests, seen, faults = bytearray(), [], set(), [0, 0, 0]
    for _, role, text in rows:
        symbol, digest = symbol_of(role, text), None
        if symbol == MUST_GO:
            faults[0] += 1
        elif (role, text) in seen:
            symbol = MUST_GO
            faults[1] += 1
        else:
            seen.add((role, text))
            faults[2] += symbol % 2
            if not whole:
                digest = hashlib.sha256(f"{conv_id}:{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        symbols.append(symbol)
        digests.append(digest)
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "conv_id": conv_id, "part": part, "frag": frag, "whole": whole, "symbols": bytes(symbols), "digests": None if whole else digests,
        "initials": None if not rows else f"{initials[0] or ' '}{initials[-1] or ' '}", "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
        "blank": faults[0], "duplicate": faults[1], "truncated": faults[2], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "roles": [r for _, r, _ in rows], "texts": [t for _, _, t in rows], "size": size,
    }


def fragments_of(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """The rows (conv_id, turn, role, text, present) in order, cut into fragments of one conversation.

    Rows that aren't present only make their conversation known.
    """
    short = [F.substring(c, 1, 64) for c in ("role", "text")]  # a range's border goes through the driver
    ranged = rows.repartitionByRange(parallelism(rows.sparkSession), F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), *short)
    ordered = ranged.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), *short, "role", "text").withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict[str, Any]] = []
        held, weight, now, part, begun = [], 0, None, 0, False
        frag, single, first = 0, True, True  # number in the range; whether it is all of its conversation; the range's first one

        def close(whole: bool) -> None:
            nonlocal held, weight, frag
            done.append(_fragment(now, part, frag, held, whole, weight))
            held, weight, frag = [], 0, frag + 1

        for batch in text_slices(batches, "text", STEP_BYTES):
            for conv_id, turn, role, text, present, part in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: B007
                if not begun or conv_id != now:
                    if begun:
                        close(single and not first)
                        first = False
                    now, single, begun = conv_id, True, True
                elif len(held) >= most_rows or weight >= most_bytes:
                    close(False)
                    single = False
                if present:
                    held.append((turn, role, text))
                    weight += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=FRAGMENTS_ARROW)
                done = []
        if begun:
            close(False)  # the next range may go on with it
            yield pa.RecordBatch.from_pylist(done, schema=FRAGMENTS_ARROW)

    return written(ordered.select("conv_id", "turn", "role", "text", "present", "part").mapInArrow(cut, FRAGMENTS), "fragments")


#: What is known of a repaired fragment.
RESULTS = (
    "conv_id long, part int, frag int, whole boolean, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string, roles array<string>, texts array<string>"
)


def _in_order(columns: dict[str, pa.Array], schema: str) -> pa.RecordBatch:
    """A batch with the columns of ``schema`` in its order, by which Spark takes them."""
    return pa.RecordBatch.from_pydict({name: columns[name] for name in (c.split()[0] for c in schema.split(", "))})


def _result(batch: pa.RecordBatch, repaired: list[Repaired], more: dict[str, list] | None = None) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in ("conv_id", "part", "frag", "whole", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")}
    columns |= {n: pa.array(v, pa.int64()) for n, v in (more or {}).items()}
    columns |= {
        "cost": pa.array([r.cost for r in repaired], pa.int64()), "audit": pa.array([r.audit for r in repaired], pa.string()),
        "roles": pa.array([r.roles for r in repaired], pa.list_(pa.string())), "texts": pa.array([r.texts for r in repaired], pa.list_(pa.string())),
    }
    return _in_order(columns, RESULTS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts batches of fragments to STEP_BYTES of text."""
    for batch in batches:
        sizes = batch.column("size").to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > STEP_BYTES or i - start >= 4096):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if sizes:
            yield batch.slice(start)


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint8) for s in batch.column("symbols").to_pylist()]


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield _result(batch, repair(list(zip(_symbols(batch), batch.column("roles").to_pylist(), batch.column("texts").to_pylist()))))


def _along(df: DataFrame, step: Callable[[dict, Any], tuple[dict, Any]], schema: str, backward: bool = False) -> DataFrame:
    """Carries a value along the fragments of each conversation, in constant memory.

    ``step`` takes a row and what is carried, None at the first fragment.
    """
    by = [F.asc_nulls_first("conv_id")] + [F.desc(c) if backward else F.asc(c) for c in ("part", "frag")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carried = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    now, carried = row["conv_id"], None
                made, carried = step(row, carried)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(run, schema)


def _over_borders(parts: DataFrame) -> DataFrame:
    """Repairs the fragments of conversations that lie in several."""
    place = ["part", "frag"]
    # rows that an earlier fragment holds as well
    single = parts.select(*place, F.posexplode("digests").alias("at", "digest")).where("digest is not null")
    earliest = single.groupBy("digest").agg(F.min(F.struct(*place)).alias("first"))
    again = single.join(earliest, "digest").where(F.struct(*place) > F.col("first")).groupBy(place).agg(F.collect_list("at").alias("again"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(tables().step), dtype=np.int16)
        for batch in text_slices(batches, "symbols", 1 << 20):
            again = batch.column("again").to_pylist()
            symbols, cut = [s.copy() for s in _symbols(batch)], []
            for s, at in zip(symbols, again):
                cut.append(int((s[at or []] % 2).sum()))
                s[at or []] = MUST_GO
            _, through = Blocks(symbols).backward(np.tile(every, (len(symbols), 1)))
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("again", "symbols")}
            columns |= {"symbols": pa.array([s.tobytes() for s in symbols], pa.binary()), "through": pa.array([t.astype("<i2").tobytes() for t in through], pa.binary())}
            columns |= {"more_duplicate": pa.array([len(a or []) for a in again], pa.int64()), "less_truncated": pa.array(cut, pa.int64())}
            yield _in_order(columns, schema)

    narrow = parts.select("conv_id", *place, "initials", "first_turn", "last_turn", "symbols").join(again, place, "left")
    schema = "conv_id long, part int, frag int, initials string, first_turn long, last_turn long, symbols binary, through binary, more_duplicate long, less_truncated long"
    known = written(narrow.mapInArrow(marked, schema), "borders")

    def vector(row: dict, carried: int | None) -> tuple[dict, int]:
        at_end = 0 if carried is None else carried
        return {"part": row["part"], "frag": row["frag"], "at_end": at_end, "closing": carried is None}, int(np.frombuffer(row["through"], "<i2")[at_end])

    ends = _along(known.select("conv_id", *place, "through"), vector, "part int, frag int, at_end int, closing boolean", backward=True)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "symbols", 1 << 20):
            blocks = Blocks(_symbols(batch))
            after, _ = blocks.backward(batch.column("at_end").to_numpy(zero_copy_only=False).astype(np.int16))
            _, last = blocks.forward(blocks.states(blocks.expanded(after)), np.tile(np.arange(4), (batch.num_rows, 1)))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "symbols"}
            yield _in_order(columns | {"leads": pa.array(last.tolist(), pa.list_(pa.int32()))}, led)

    mapped = known.drop("through").join(ends, place).select("conv_id", *place, "initials", "first_turn", "last_turn", "more_duplicate", "less_truncated", "at_end", "closing", "symbols")
    led = "conv_id long, part int, frag int, initials string, first_turn long, last_turn long, more_duplicate long, less_truncated long, at_end int, closing boolean, leads array<int>"
    mapped = mapped.mapInArrow(states, led)

    def state(row: dict, carried: tuple | None) -> tuple[dict, tuple]:
        at_start, initial, turn = carried or (START, None, None)
        initials = row["initials"]
        made = {
            "part": row["part"], "frag": row["frag"], "at_start": at_start, "at_end": row["at_end"], "closing": row["closing"],
            "more_duplicate": row["more_duplicate"], "less_truncated": row["less_truncated"],
            "more_illegal": int(initial is not None and initials is not None and initial + initials[0] not in LEGAL), "less_turns": int(turn is not None and turn == row["first_turn"]),
        }
        return made, (row["leads"][at_start], initials[1] if initials else initial, row["last_turn"] if row["last_turn"] is not None else turn)

    borders = _along(mapped, state, "part int, frag int, at_start int, at_end int, closing boolean, more_duplicate long, less_truncated long, more_illegal long, less_turns long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            col = {n: batch.column(n).to_pylist() for n in ("roles", "texts", "at_end", "at_start", "closing", "duplicate", "more_duplicate", "truncated", "less_truncated", "illegal", "more_illegal", "turns", "less_turns")}
            repaired = repair(list(zip(_symbols(batch), col["roles"], col["texts"])), col["at_end"], col["at_start"], col["closing"])
            yield _result(batch, repaired, {
                "duplicate": [a + b for a, b in zip(col["duplicate"], col["more_duplicate"])], "truncated": [a - b for a, b in zip(col["truncated"], col["less_truncated"])],
                "illegal": [a + b for a, b in zip(col["illegal"], col["more_illegal"])], "turns": [a - b for a, b in zip(col["turns"], col["less_turns"])],
            })

    joined = parts.drop("symbols", "digests", "initials").join(known.select(*place, "symbols"), place).join(borders, place)
    return joined.mapInArrow(trace, RESULTS)


def repair_conversations(rows: DataFrame, fragment_rows: int = FRAGMENT_ROWS, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """Repaired fragments of all conversations of ``rows`` (conv_id, turn, role, text and, if some rows
    only make their conversation known, present).

    One row per fragment, nearly always a whole conversation: conv_id, part, frag (their order),
    whole, first_turn, last_turn, turns (distinct ones), blank, duplicate, truncated, illegal, cost, audit,
    and the repaired rows as roles and texts.  Null roles and texts count as one space; a null
    conv_id is a conversation; null turns come first, rows of one turn by the first 64 letters of
    role and text, then by all of them; other columns are ignored; an empty table gives no rows.
    """
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    narrow = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    fragments = fragments_of(narrow, fragment_rows, fragment_bytes)
    return fragments.where("whole").mapInArrow(_repair_whole, RESULTS).unionByName(_over_borders(fragments.where("not whole")))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def conversation_digests(fragments: DataFrame) -> DataFrame:
    """One row per conversation: its counts, gaps in its turns, audit, and the SHA-256 of its
    repaired ``role:text`` rows joined by line ends.

    A digest is sequential: the fragments of a conversation that lies in several stream in
    order through one task, which holds one fragment and the audit.
    """
    text = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    single = fragments.where("whole").select("conv_id", gaps.alias("gaps"), *_COUNTS, "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, fresh = None, False, True
        total, audit, digest, low, high = {}, [], hashlib.sha256(), None, None

        def row() -> pa.RecordBatch:
            gap = high - low + 1 - total["turns"] if low is not None else 0
            out = {"conv_id": now, "gaps": gap, **{c: total[c] for c in _COUNTS}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([out], schema=pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in out]))

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if not begun or r["conv_id"] != now:
                    if begun:
                        yield row()
                    now, begun, fresh = r["conv_id"], True, True
                    total, audit, digest, low, high = dict.fromkeys((*_COUNTS, "turns"), 0), [], hashlib.sha256(), None, None
                for c in total:
                    total[c] += r[c]
                audit.append(r["audit"])
                low = r["first_turn"] if low is None else low
                high = r["last_turn"] if r["last_turn"] is not None else high
                for role, said in zip(r["roles"], r["texts"]):
                    digest.update(f"{'' if fresh else chr(10)}{role}:{said}".encode("utf-8", "surrogatepass"))
                    fresh = False
        if begun:
            yield row()

    ordered = fragments.where("not whole").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "frag")
    return single.unionByName(ordered.mapInArrow(stream, SUMMARY))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults set by ``crc32(conv_id:turn) % 20``: 0 not present, 1 an empty text, 2 no
    ``.!?``, 3 the row twice, 4 the role user.  Nulls count as one space."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(texts["conv_id"], F.lit(":"), texts["turn"]).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", texts["role"].alias("role"), texts["text"].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), twice.alias("copy")).drop("copy")
