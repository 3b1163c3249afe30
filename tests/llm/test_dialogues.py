import itertools
import random
import re
import zlib
from hashlib import md5, sha256

import duckdb
import numpy as np
import pytest

from backhaul.llm import dialogues, queries

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit, roles and texts) by trying all edits; turns are (role, text, class) with class
    gone, open or whole."""
    states = {"start": (0, "", ())}

    def follow(state):
        return "a" if state == "u" else "u"

    def inserted(states):
        for _ in range(3):
            new = dict(states)
            for state, (cost, audit, out) in states.items():
                to = follow(state)
                role = "user" if to == "u" else "assistant"
                option = (cost + 2, audit + "I", (*out, (role, "")))
                new[to] = min(new.get(to, option), option)
            states = new
        return states

    for role, text, kind in turns:
        new = {}

        def add(state, option):
            new[state] = min(new.get(state, option), option)

        for state, (cost, audit, out) in inserted(states).items():
            add(state, (cost + 3, audit + "D", out))
            if kind == "gone":
                continue
            more = kind == "open"
            if role[:1] == "s" and state == "start":
                add("s", (cost + more, audit + "K", (*out, (role, text))))
            for to, name in (("u", "user"), ("a", "assistant")):
                if follow(state) == to:
                    if role[:1] == to:
                        add(to, (cost + more, audit + "K", (*out, (role, text))))
                    add(to, (cost + 2 + more, audit + "R", (*out, (name, text))))
        states = new
    states = inserted(states)
    return min(states[s] for s in ("start", "a") if s in states)


def classed(rows):
    """Rows (turn, role, text) in order with their class, and the counts of faults."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ")
                   for t, r, x in rows),
                  key=lambda y: (y[0] is not None, y[0] or 0,
                                 md5(f"{len(y[1].encode())}:{y[1]}{y[2]}".encode()).digest()))
    seen, turns, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        if not bare:
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        else:
            kind = "truncated" if bare[-1] not in ".!?" else "whole"
        seen.add((role, text))
        if kind in counts:
            counts[kind] += 1
        turns.append((role, text, {"truncated": "open", "whole": "whole"}.get(kind, "gone")))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(turns)]
    return turns, (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs))


def damaged(rows):
    for conv, turn, role, text in rows:
        code = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(code.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def brute(rows, everyone=()):
    by_conv = {conv: [] for conv in everyone}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    result = []
    for conv, some in by_conv.items():
        turns, counts = classed(some)
        cost, audit, out = cheapest(turns)
        text = "\n".join(f"{r}:{t}" for r, t in out)
        result.append((conv, *counts, cost, audit, sha256(text.encode()).hexdigest()))
    return sorted(result, key=str)


def run(spark, rows, schema=SCHEMA, **options):
    done = dialogues.repair(spark.createDataFrame(rows, schema), **options)
    texts = {r.conv_id: r.sha256 for r in dialogues.digests(done.turns).collect()}
    empty = sha256().hexdigest()
    return sorted(((*r, texts.get(r.conv_id, empty)) for r in done.audits.collect()), key=str)


def dialogue(rng, conv, n, plain=0.5):
    roles = ["user", "assistant", "system", "tool", "", None, "u2"]
    rows = []
    for i in range(n):
        role = ("user", "assistant")[i % 2] if rng.random() < plain else rng.choice(roles)
        text = rng.choice([f"Text {i}.", f"open {i}", "again!", "", " \n", None, f"{i}? \t"])
        rows.append((conv, i if rng.random() < 0.9 else None, role, text))
    return rows


def test_all_short_scripts():
    """The tables against every edit script of up to three turns, tested by the expression itself."""
    rng = random.Random(3)
    cases = [c for n in range(3) for c in itertools.product(range(9), repeat=n)]
    cases += [tuple(rng.randrange(9) for _ in range(3)) for _ in range(12)]
    gaps = ["", "u", "a", "ua", "au"]
    for case in cases:
        best = None
        for inserts in itertools.product(gaps, repeat=len(case) + 1):
            for edits in itertools.product("DKua", repeat=len(case)):
                initials, audit, cost = inserts[0], "I" * len(inserts[0]), 2 * len(inserts[0])
                for symbol, edit, after in zip(case, edits, inserts[1:]):
                    kind, is_open = divmod(symbol - 1, 2) if symbol else (None, 0)
                    if edit == "D":
                        cost, audit = cost + 3, audit + "D"
                    elif kind is None:
                        break
                    elif edit == "K":
                        initials, audit = initials + "suax"[kind], audit + "K"
                        cost += is_open
                    else:
                        initials, audit, cost = initials + edit, audit + "R", cost + 2 + is_open
                    initials, audit, cost = initials + after, audit + "I" * len(after), cost + 2 * len(after)
                else:
                    if re.fullmatch("(s?(ua)+)?", initials):
                        best = min(best or (cost, audit), (cost, audit))
        codes, t = np.array(case, np.int64), dialogues.tables()
        ahead, added = dialogues.summary(codes)
        steps = dialogues.trace(codes, t.end, dialogues.START)
        last = steps[-1][1] if steps else dialogues.START
        audit = "".join(e for e, _ in steps) + dialogues.finish(last)
        assert (added[t.end] + t.vectors[ahead[t.end]][dialogues.START], audit) == best, case


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [row for conv in [*range(40), None]
            for row in dialogue(rng, conv, rng.randrange(1, 14))]
    rows += [rng.choice(rows) for _ in range(30)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, most_turns=3) == brute(rows)


def test_one_hot_conversation_in_many_pieces(spark):
    rng = random.Random(9)
    rows = dialogue(rng, 7, 3000, 0.8) + [(7, 5, "user", "the same.")] * 1000
    rows += dialogue(rng, 8, 5)
    for size in (1, 64, 1 << 16):
        assert run(spark, rows, most_turns=size) == brute(rows)


def test_pieces_meet_across_ranges(spark):
    """Sorted ranges cut a conversation; the cut is not a cut of the result."""
    rng = random.Random(11)
    rows = dialogue(rng, 1, 400, 0.9)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = dialogues.repair(frame, most_turns=50)
        got = done.audits.collect()
        pieces = done.turns.select("piece").distinct().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len({p.piece >> 33 for p in pieces}) > 1
    assert [tuple(r) for r in got] == [r[:-1] for r in brute(rows)]


def test_long_text_clashing_columns_and_no_rows(spark):
    schema = SCHEMA + ", conv long, key string, piece long, place long, first string, copies long"
    rows = [(1, 0, "user", "long. " * 400_000), (1, 1, "assistant", "x" * 3_000_000)]
    assert run(spark, [(*r, 1, "x", 1, 1, "x", 1) for r in rows], schema) == brute(rows)
    assert run(spark, [], schema) == []


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "tool", "So?"),
            (1, 3, "assistant", "Yes."), (1, 4, "assistant", " ")]
    turns = dialogues.repair(spark.createDataFrame(rows, SCHEMA)).turns.orderBy("piece", "place")
    got = [tuple(r) for r in turns.select("role", "text", "new").collect()]
    assert got == [("system", "Be brief.", False), ("user", "", True),
                   ("assistant", "Hello.", False), ("user", "So?", False),
                   ("assistant", "Yes.", False)]


def test_damage(spark):
    rows = [(c, t, r, "a. b! c?") for c in (None, *range(30)) for t, r in
            [(None, "user"), (0, None), (1, "assistant"), (2, "system")]]
    rows += [(5, 9, "user", None)]
    got = dialogues.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(damaged(rows), key=str)


def test_query_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    expected = brute(damaged(rows), {r[0] for r in rows})
    got = queries.op12_conversation_repair(spark, DATA)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
               "repaired_sha256"]
    assert got.columns == columns
    assert {f.dataType.simpleString() for f in got.schema[:7]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == expected
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    found = db.execute(queries.oracle_sql()["op12_conversation_repair"]).fetchall()
    assert sorted(found, key=str) == expected


def test_conversation_that_is_lost_whole(spark, tmp_path):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (spark.createDataFrame([(lost, 0, "user", "a."), (None, None, None, None)], SCHEMA)
     .write.parquet(f"{tmp_path}/conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in
           queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    empty = sha256().hexdigest()
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[None] == (0, 1, 0, 0, 0, 3, "D", empty)
