"""Repair of conversations: the cheapest edits that leave roles in order, and the repaired turns.

A conversation is in order if its roles' initials read ``(s?(ua)+)?``: perhaps a system turn, then
user and assistant in turn, an assistant at the end. A blank turn, or one whose role and text were
seen before, has to go; a truncated one, without a full stop at its end, costs 1 if it stays. Edits:
Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2. Of the
cheapest edit scripts the one whose initials are least is taken.

**Four Russians.** Reading a conversation so far leaves one of four states: nothing yet, a system, a
user or an assistant turn last. What the rest costs is a vector of four numbers, computed from the
end. From any state another is reached by a few edits, so the numbers differ by little, and less
their minimum there are few such vectors (16). A turn is one of nine symbols. For each block of
BLOCK symbols a table gives, for every vector behind it, the vector ahead of it and what that adds
to the minimum; conversations are processed by looking blocks up. To trace, the vectors inside a
block are expanded backward from the one behind it, and the script is read forward: in each state
the least edit that stays cheapest. As that is decided by what is still to come, ties are safe.

**At scale.** Rows equal in conversation, turn, role and text become one with a count before
anything is shuffled by order. The rest, without texts, is sorted by ranges and cut into pieces of at
most PIECE turns. A piece is summed up by the vector ahead of it for every vector behind it, so
pieces of one conversation in many tasks are put together by 16 numbers each, then traced
side by side. A text is joined to its edit by conversation, turn and digest. Of one
conversation only its pieces' summaries meet in one task (a row for 65,536 turns), its audit, and
the bytes that stream through the digest of its repaired text.

Defined cases: a null role or text is one space. Turns are ordered with nulls first; turns of equal
number by the MD5 of role and text. A row repeated exactly is a duplicate. A row without a
conversation id belongs to the conversation null. A role that does not begin with s, u or a (also an
empty one) cannot be kept. Texts of any length are read whole, further columns are not. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from backhaul.llm.batches import pieces as split
from backhaul.llm.scratch import Scratch

#: Symbols of a block whose transitions are looked up at once.
BLOCK = 4
#: Turns of a piece at most.
PIECE = 1 << 16

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What counts as space.
SPACE = " \t\n\x0b\x0c\r"
#: What ends a whole turn.
STOPS = ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant turn, whichever may follow, leads to.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Role classes in the order of their codes; any other initial is 3.
CLASSES = "sua"
#: Symbol 0 must be deleted; class c, truncated or not, is 1 + 2 c + truncated.
SYMBOLS = 9
NEVER = 1 << 20


# ---- tables, in plain Python -----------------------------------------------------------------

def _closed(ahead: list[int]) -> tuple[int, ...]:
    """Costs to go when turns may be inserted first."""
    for _ in range(2):
        ahead = [min(c, INSERT + ahead[FOLLOWS[s]]) for s, c in enumerate(ahead)]
    return tuple(ahead)


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a turn in a state: initial, cost, next state."""
    options = [("D", DELETE, state)]
    if symbol:
        kind, truncated = divmod(symbol - 1, 2)
        target = FOLLOWS[state]
        if kind == 0 and state == START:
            options.append(("K", truncated * TRUNCATED, SYSTEM))
        if kind == target - 1:
            options.append(("K", truncated * TRUNCATED, target))
        else:
            options.append(("R", REROLE + truncated * TRUNCATED, target))
    return options


def _ahead(symbol: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    return _closed([min(cost + behind[to] for _, cost, to in _options(symbol, state))
                    for state in range(4)])


def _script(symbol: int, behind: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least of the cheapest edits up to and including one turn, and the state after it."""
    costs, edits = _ahead(symbol, behind), ""
    while True:
        best = sorted((edit, to) for edit, cost, to in _options(symbol, state)
                      if cost + behind[to] == costs[state])
        inserted = FOLLOWS[state]
        if INSERT + costs[inserted] == costs[state] and (not best or best[0][0] > "I"):
            edits, state = edits + "I", inserted
        else:
            return edits + best[0][0], best[0][1]


@dataclass(frozen=True)
class Tables:
    """``vectors`` less their minimum; ``end`` is the one behind the last turn. ``ahead[b, v]`` and
    ``added[b, v]`` for blocks of BLOCK symbols, ``ahead1`` and ``added1`` for one. ``script`` is
    the edits of one turn by symbol, vector behind it and state."""

    vectors: list[tuple[int, ...]]
    end: int
    ahead: np.ndarray
    added: np.ndarray
    ahead1: np.ndarray
    added1: np.ndarray
    script: dict[tuple[int, int, int], tuple[str, int]]


@cache
def tables() -> Tables:
    finish = _closed([0, NEVER, NEVER, 0])
    ids, found = {finish: 0}, [finish]
    steps: list[list[tuple[int, int]]] = []
    for vector in found:
        row = []
        for symbol in range(SYMBOLS):
            ahead = _ahead(symbol, vector)
            least = min(ahead)
            ahead = tuple(c - least for c in ahead)
            if ahead not in ids:
                ids[ahead] = len(found)
                found.append(ahead)
            row.append((ids[ahead], least))
        steps.append(row)
    ahead1 = np.array([[to for to, _ in row] for row in steps], np.int64).T.copy()
    added1 = np.array([[cost for _, cost in row] for row in steps], np.int64).T.copy()
    ahead, added = ahead1, added1
    for _ in range(BLOCK - 1):
        # one more symbol in front: its step is taken from the vector ahead of the block
        added = (added[None] + added1[:, ahead]).reshape(-1, len(found))
        ahead = ahead1[:, ahead].reshape(-1, len(found))
    script = {(symbol, v, state): _script(symbol, vector, state)
              for symbol in range(SYMBOLS) for v, vector in enumerate(found)
              for state in range(4)}
    return Tables(found, 0, ahead, added, ahead1, added1, script)


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first symbols that fill no block, and the numbers of the blocks after them."""
    odd = len(symbols) % BLOCK
    powers = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
    return symbols[:odd], symbols[odd:].reshape(-1, BLOCK) @ powers


def summary(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector behind the symbols: the vector ahead of them, and the cost that they add."""
    t = tables()
    odd, blocks = _codes(symbols)
    at, cost = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    for block in blocks[::-1]:
        cost += t.added[block, at]
        at = t.ahead[block, at]
    for symbol in odd[::-1]:
        cost += t.added1[symbol, at]
        at = t.ahead1[symbol, at]
    return at, cost


def trace(symbols: np.ndarray, behind: int, state: int) -> list[tuple[str, int]]:
    """Per symbol its edits, inserts before it included, and the state after it.

    ``behind`` is the vector behind the last symbol, ``state`` the one before the first.
    """
    t = tables()
    odd, blocks = _codes(symbols)
    edges = [behind]
    for block in blocks[::-1]:
        edges.append(int(t.ahead[block, edges[-1]]))
    edits: list[tuple[str, int]] = []

    def expand(part: np.ndarray, vector: int) -> None:
        nonlocal state
        vectors = []
        for symbol in part[::-1]:
            vectors.append(vector)
            vector = int(t.ahead1[symbol, vector])
        for symbol in part:
            done = t.script[int(symbol), vectors.pop(), state]
            edits.append(done)
            state = done[1]

    expand(odd, edges[-1])
    for i in range(len(blocks)):
        expand(symbols[len(odd) + i * BLOCK:len(odd) + (i + 1) * BLOCK], edges[-2 - i])
    return edits


def finish(state: int) -> str:
    """The turns to insert after the last one."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def inserted(n: int, state: int) -> tuple[list[str], int]:
    """Roles of ``n`` turns inserted in a state, and the state after them."""
    roles = []
    for _ in range(n):
        state = FOLLOWS[state]
        roles.append(ROLES[state])
    return roles, state


# ---- the distributed table -------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, text with faults by crc32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 takes its stops away, 3 repeats it, 4 makes it a user's.
    A null counts as one space."""
    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    role, text = spaced("role"), spaced("text")
    return (rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))
            .filter("fault <> 0")
            .select("conv_id", "turn",
                    F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"),
                    F.when(F.col("fault") == 1, "")
                    .when(F.col("fault") == 2, F.translate(text, STOPS, "")).otherwise(text)
                    .alias("text"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1)))
                              .otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _keyed(rows: DataFrame, id_column: str, turn_column: str) -> DataFrame:
    """conv, turn, key (digest of role and text), role, text."""
    plain = rows.select(F.col(id_column).alias("conv"), F.col(turn_column).alias("turn"),
                        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    written = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return plain.withColumn("key", F.unhex(F.md5(written)))


def _units(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per conversation, turn, role and text, with the number of such rows and whether
    role and text are seen there first."""
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.coalesce(*[F.when(initial == c, F.lit(i)) for i, c in enumerate(CLASSES)],
                      F.lit(len(CLASSES)))
    units = scratch.keep(
        keyed.select("conv", "turn", "key", kind.alias("kind"), (bare == "").alias("blank"),
                     (~F.substring(bare, -1, 1).isin(*STOPS)).alias("open"))
        .groupBy("conv", "turn", "key")
        .agg(F.max("kind").alias("kind"), F.max("blank").alias("blank"),
             F.max("open").alias("open"), F.count(F.lit(1)).alias("copies")))
    ranked = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    firsts = (units.groupBy("conv", "key").agg(F.min(ranked).alias("first"))
              .select(F.col("conv").alias("c"), F.col("key").alias("k"),
                      F.col("first.turn").alias("t")))
    same = (F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
            & F.col("turn").eqNullSafe(F.col("t")))
    return (units.join(firsts, same, "left")
            .withColumn("first", F.col("k").isNotNull()).drop("c", "k", "t"))


def _pieces(units: DataFrame, most: int) -> DataFrame:
    """Pieces of ``most`` turns at most, ordered by ``piece``, each with its turns and its
    summary."""
    symbol = F.when(F.col("blank") | ~F.col("first"), 0).otherwise(
        1 + 2 * F.col("kind") + F.col("open").cast("int"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    ranged = (units.select("conv", "turn", "key", "kind", "copies", symbol.alias("symbol"))
              .repartitionByRange(*order).sortWithinPartitions(*order))
    schema = T.StructType([
        units.schema["conv"], T.StructField("piece", T.LongType()),
        T.StructField("symbols", T.BinaryType()), T.StructField("copies", T.ArrayType(T.LongType())),
        T.StructField("turns", T.ArrayType(units.schema["turn"].dataType)),
        T.StructField("keys", T.ArrayType(T.BinaryType())),
        T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
        T.StructField("illegal", T.LongType()), T.StructField("ahead", T.ArrayType(T.LongType())),
        T.StructField("added", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def piece_of(conv, number: int, rows: list[tuple]) -> tuple:
        turns, keys, kinds, copies, symbols = zip(*rows)
        kinds, codes = np.array(kinds), np.array(symbols, np.int64)
        ahead, added = summary(codes)
        repeats = sum(copies) - len(copies)
        illegal = repeats + int((~_legal(kinds[:-1], kinds[1:])).sum())
        return (conv, number, codes.astype(np.uint8).tobytes(), list(copies), list(turns),
                list(keys), int(kinds[0]), int(kinds[-1]), illegal, ahead.tolist(),
                (added + DELETE * repeats).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        conv, rows, done = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row_conv, *row in zip(*columns):
                if rows and (row_conv != conv or len(rows) == most):
                    done.append(piece_of(conv, number, rows))
                    number, rows = number + 1, []
                conv = row_conv
                rows.append(tuple(row))
            if len(done) >= 1000 or sum(len(p[3]) for p in done[-4:]) > most:
                yield _batch(done, arrow)
                done = []
        if rows:
            done.append(piece_of(conv, number, rows))
        if done:
            yield _batch(done, arrow)

    return ranged.mapInArrow(run, schema)


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether role classes may stand side by side: su, ua or au."""
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, f.type) for column, f in zip(zip(*rows), schema, strict=True)],
        schema=schema)


def _streamed(rows: DataFrame, order: list, schema: T.StructType, work) -> DataFrame:
    """``work``, from a conversation's rows in their order to result rows, over sorted streams.

    A conversation's rows are in one task but never together in memory.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything = (row for batch in batches
                      for row in zip(*[c.to_pylist() for c in batch.columns]))
        done = []
        for conv, group in groupby(everything, key=lambda row: row[0]):
            for result in work(row[1:] for row in group):
                done.append((conv, *result))
                if len(done) == 10_000:
                    yield _batch(done, arrow)
                    done = []
        if done:
            yield _batch(done, arrow)

    return (rows.repartition("conv").sortWithinPartitions("conv", *order)
            .mapInArrow(run, schema))


def _behind(pieces: DataFrame) -> DataFrame:
    """Per piece: the vector behind it, the cost from its start, whether it is the last one."""
    conv = pieces.schema["conv"]
    schema = T.StructType([
        conv, T.StructField("piece", T.LongType()), T.StructField("behind", T.IntegerType()),
        T.StructField("last", T.BooleanType()), T.StructField("cost", T.LongType()),
        T.StructField("between", T.LongType())])

    def work(rows):
        t = tables()
        vector, cost, after = t.end, 0, None
        for piece, ahead, added, left, right in rows:
            between = 0 if after is None else int(not _legal(right, after))
            behind, cost, vector = vector, cost + added[vector], ahead[vector]
            yield piece, behind, after is None, cost + t.vectors[vector][START], between
            after = left

    return _streamed(pieces.select("conv", "piece", "ahead", "added", "left", "right"),
                     [F.desc("piece")], schema, work)


def _starts(traced: DataFrame) -> DataFrame:
    """Per piece: the state before it."""
    schema = T.StructType([traced.schema["conv"], T.StructField("piece", T.LongType()),
                           T.StructField("start", T.IntegerType())])

    def work(rows):
        state = START
        for piece, ends in rows:
            yield piece, state
            state = ends[state] if ends else state

    return _streamed(traced, ["piece"], schema, work)


def _with_ends(pieces: DataFrame) -> DataFrame:
    """Per piece: the state after it for each state before it; null for a last piece."""
    schema = T.StructType([pieces.schema["conv"], T.StructField("piece", T.LongType()),
                           T.StructField("ends", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch([
                    (conv, piece, None if last else
                     [trace(np.frombuffer(symbols, np.uint8).astype(np.int64), behind, state)[-1][1]
                      for state in range(4)])
                    for conv, piece, symbols, behind, last in
                    zip(*[c.to_pylist() for c in batch.columns])], arrow)

    return pieces.select("conv", "piece", "symbols", "behind", "last").mapInArrow(run, schema)


def _scripts(pieces: DataFrame) -> DataFrame:
    """Per piece: its audit, cost and illegal neighbours, and the turns that are left of it: turn
    and key of their row, null for an inserted one; the role, null where the row's own is kept."""
    turn = T.StructType([
        T.StructField("place", T.LongType()),
        T.StructField("turn", pieces.schema["turns"].dataType.elementType),
        T.StructField("key", T.BinaryType()), T.StructField("new_role", T.StringType())])
    schema = T.StructType([
        pieces.schema["conv"], T.StructField("piece", T.LongType()),
        T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()),
        T.StructField("audit", T.StringType()), T.StructField("left", T.ArrayType(turn))])
    arrow = to_arrow_schema(schema)

    def script_of(symbols, copies, turns, keys, behind, last, state):
        codes = np.frombuffer(symbols, np.uint8).astype(np.int64)
        audit, left = [], []
        for (edits, after), n, number, key in zip(trace(codes, behind, state), copies, turns, keys):
            audit.append(edits + "D" * (n - 1))
            roles, state = inserted(len(edits) - 1, state)
            left += [(None, None, role) for role in roles]
            if edits[-1] != "D":
                left.append((number, key, ROLES[FOLLOWS[state]] if edits[-1] == "R" else None))
            state = after
        if last:
            audit.append(finish(state))
            left += [(None, None, role) for role in inserted(len(audit[-1]), state)[0]]
        return "".join(audit), [dict(place=i, turn=t, key=k, new_role=r)
                                for i, (t, k, r) in enumerate(left)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                columns = [c.to_pylist() for c in batch.slice(at, 64).columns]
                yield _batch([(conv, piece, cost, illegal, *script_of(*rest))
                              for conv, piece, cost, illegal, *rest in zip(*columns)], arrow)

    return (pieces.select("conv", "piece", "cost", F.expr("illegal + between").alias("illegal"),
                          "symbols", "copies", "turns", "keys", "behind", "last", "start")
            .mapInArrow(run, schema))


@dataclass(frozen=True)
class Repair:
    """``audits``: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every
    conversation that has rows. ``turns``: conv_id, piece, place, role, text and whether the turn
    is ``new``; in the order of piece and place they are the repaired conversation."""

    audits: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn",
           most_turns: int = PIECE) -> Repair:
    """The cheapest repair of every conversation of ``rows`` (with columns role and text).

    ``gaps`` counts the numbers between the least and the greatest turn that no row has.
    ``most_turns`` is the size of a piece; the result does not depend on it.
    """
    scratch = Scratch(rows.sparkSession, "dialogues")
    keyed = _keyed(rows, id_column, turn_column)
    units = scratch.keep(_units(keyed, scratch))
    pieces = scratch.keep(_pieces(units, most_turns))
    behind = _behind(pieces).drop("conv")
    pieces = scratch.keep(pieces.drop("ahead", "added").join(behind, "piece"))
    starts = _starts(_with_ends(pieces)).drop("conv")
    scripts = scratch.keep(_scripts(pieces.join(starts, "piece")))

    whole = ~F.col("blank") & F.col("first")
    faults = (units.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
        .cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0)
              .otherwise(F.col("copies") - F.col("first").cast("long"))).alias("duplicate"),
        F.count_if(whole & F.col("open")).alias("truncated")))
    parts = F.array_sort(F.collect_list(F.struct("piece", "audit")))
    costs = (scripts.groupBy(F.col("conv").alias("c"))
             .agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "piece").alias("cost"),
                  F.array_join(parts["audit"], "").alias("audit")))
    audits = (faults.join(costs, F.col("conv").eqNullSafe(F.col("c")))
              .select(F.col("conv").alias(id_column), "gaps", "blank", "duplicate", "truncated",
                      "illegal", "cost", "audit"))

    left = scripts.select("conv", "piece", F.inline("left"))
    texts = (keyed.groupBy("conv", "turn", "key")
             .agg(F.first("role").alias("role"), F.first("text").alias("text"))
             .select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("key").alias("k"),
                     "role", "text"))
    same = (F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
            & (F.col("key") == F.col("k")))
    old = (left.filter("key IS NOT NULL").join(texts, same)
           .select(F.col("conv").alias(id_column), "piece", "place",
                   F.coalesce("new_role", "role").alias("role"), "text",
                   F.lit(False).alias("new")))
    new = (left.filter("key IS NULL")
           .select(F.col("conv").alias(id_column), "piece", "place",
                   F.col("new_role").alias("role"), F.lit("").alias("text"),
                   F.lit(True).alias("new")))
    return Repair(audits, old.unionByName(new))


def digests(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Column ``sha256`` per conversation: of ``role:text`` of its turns, joined by newlines.

    A digest is sequential: a conversation's text streams through one task, a batch at a time.
    """
    schema = T.StructType([turns.schema[id_column], T.StructField("sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []
        for batch in batches:
            for piece in split(batch, "text"):
                for row_conv, role, text in zip(*[c.to_pylist() for c in piece.columns]):
                    if state is None or row_conv != conv:
                        if state is not None:
                            done.append((conv, state.hexdigest()))
                        conv, state = row_conv, sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{role}:{text}".encode())
                if done:
                    yield _batch(done, arrow)
                    done = []
        if state is not None:
            yield _batch([(conv, state.hexdigest())], arrow)

    return (turns.repartition(id_column).sortWithinPartitions(id_column, "piece", "place")
            .select(id_column, "role", "text").mapInArrow(run, schema))


def duckdb_sql(table: str, crc32: str) -> str:
    """Damage and repair of ``table`` for DuckDB; ``crc32`` is an expression of column ``code``."""
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def best(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def step(state: str, cost: int | str, edit: str, line: str = "''") -> str:
        return (f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', "
                f"'o': {state}.o || {line}}}")

    def insert(state: str, role: str) -> str:
        return step(state, INSERT, "I", f"chr(10) || '{role}:'")

    never = f"{{'c': {NEVER}::BIGINT, 'a': '', 'o': ''}}"
    own, new = "chr(10) || role || ':' || text", "chr(10) || '{}:' || text"

    def turn(state: str, role: str) -> str:
        """A turn that becomes a user's or an assistant's."""
        return (f"CASE WHEN initial = '{role[0]}' THEN {step(state, 'open', 'K', own)} "
                f"ELSE {step(state, f'{REROLE} + open', 'R', new.format(role))} END")

    def closed(columns: str, source: str) -> str:
        """Turns inserted before what follows."""
        return f"""SELECT {columns}, s0, s1, s2, {best("s3", insert("s2", "assistant"))} AS s3 FROM (
            SELECT {columns}, s0, s1, {best("s2", insert("s0", "user"), insert("s1", "user"),
                                             insert("s3", "user"))} AS s2, s3 FROM {source})"""

    return f"""
WITH RECURSIVE plain AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS code
    FROM {table}),
faulty AS (SELECT *, {crc32} % 20 AS fault FROM plain),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '{STOPS}', '') ELSE text END AS text
    FROM faulty, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END)
    WHERE fault <> 0),
numbered AS (
    SELECT *, substr(role, 1, 1) AS initial, rtrim(text, {space}) AS bare,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                              md5(strlen(role) || ':' || role || text)) AS n
    FROM damaged),
marked AS (
    SELECT *, bare = '' AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS previous
    FROM numbered),
turns AS (
    SELECT conv_id, n, turn, role, text, initial, previous, blank, NOT blank AND seen AS duplicate,
           (NOT blank AND NOT seen AND NOT contains('{STOPS}', right(bare, 1)))::BIGINT AS open
    FROM marked),
walk AS (
    SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {never} AS s1,
           {never} AS s2, {never} AS s3
    FROM (SELECT DISTINCT conv_id FROM turns)
    UNION ALL
    SELECT conv_id, n + 1,
           {step("s0", DELETE, "D")},
           CASE WHEN gone OR initial <> 's' THEN {step("s1", DELETE, "D")}
                ELSE {best(step("s1", DELETE, "D"), step("s0", "open", "K", own))} END,
           CASE WHEN gone THEN {step("s2", DELETE, "D")}
                ELSE {best(step("s2", DELETE, "D"), turn("s0", "user"), turn("s1", "user"),
                           turn("s3", "user"))} END,
           CASE WHEN gone THEN {step("s3", DELETE, "D")}
                ELSE {best(step("s3", DELETE, "D"), turn("s2", "assistant"))} END
    FROM ({closed("conv_id, n, role, text, initial, gone, open",
                  "(SELECT w.conv_id, w.n, s0, s1, s2, s3, t.role, t.text, t.initial, t.open, "
                  "t.blank OR t.duplicate AS gone FROM walk w JOIN turns t "
                  "ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1)")})),
ends AS (
    SELECT conv_id, {best("s0", "s3")} AS s
    FROM ({closed("conv_id, n", "walk")})
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
faults AS (
    SELECT conv_id,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
           sum(open)::BIGINT AS truncated,
           count(*) FILTER (WHERE n > 1 AND previous || initial NOT IN ('su', 'ua', 'au'))
           AS illegal
    FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank,
       coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
       coalesce(f.illegal, 0) AS illegal, coalesce(e.s.c, 0) AS cost, coalesce(e.s.a, '') AS audit,
       sha256(coalesce(substr(e.s.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {table}) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""
