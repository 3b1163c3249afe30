"""Secret scan: fixed patterns, and a lexer of assignments that propagates constants.

The lexer reads a text as source or configuration code: ``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``NAME=literal``, ``name => 'literal'``, ``name: type = "literal"``,
``name["name"] = "literal"``, ``name += "literal"``, with literals that have a prefix or three quotes,
literals and names joined by ``+`` or ``.``, and names that stand for an earlier value. A pair is a
secret if its target name sounds sensitive and the whole value looks like a credential. Through a
chain of names the literals themselves are reported, where they were written; a name of which
nothing is known adds nothing.

Spans count code points, the end is exclusive. A null text is scanned as an empty one. Ids are
only carried along: null and repeated ids give a row each. Spans that start together are listed in
the order of their kinds. Texts of any length are read whole, in time and memory that grow with them.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from backhaul.llm.batches import id_and_text, map_text

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "literal", "constant")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

TARGET = re.compile(
    r"""(?<![\w.$-])(["'`]?)(?P<name>[A-Za-z_$][\w.$-]*+)\1
        (?P<keys>(?:[ \t]*+\[[ \t]*+(?:"[^"\n]*+"|'[^'\n]*+'|[\w.$]*+)[ \t]*+\])*+)[ \t]*+
        (?: :(?![/:=])[ \t]*+(?P<type>
              [&*\[]*+(?:'\w++[ \t]++)?+(?:(?:const|static|dyn|mut|unsigned|readonly)[ \t]++)*+
              (?P<last>[A-Za-z_](?:[\w.]|::)*+)(?:[<\[;][^\n="'`:]*+)?+[*&?\]]*+
              (?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+(?:\[\])?+)*+)
            (?: [ \t]++=(?![=>]) | =(?=[ \t]*+(?:[A-Za-z@$]{1,2})?+["'`]) )
          | (?P<more>\+=) | :=|=>|=(?!=)|:(?!/) )
        [ \t]*+(?:\([ \t]*+(?:\r?\n[ \t]*+)?+(?=[A-Za-z@$]{0,2}["'`]))?+""", re.VERBOSE | re.ASCII)
TRIPLE = re.compile(r"""(?:[A-Za-z]{1,2}|[@$]{1,2})?+(?P<quote>\"{3}|'{3})(?P<value>(?:[^\\]|\\.)*?)(?P=quote)""",
                    re.ASCII | re.DOTALL)
QUOTED = re.compile(
    r"""(?:[A-Za-z]{1,2}|[@$]{1,2})?+(?P<quote>["'`])
        (?P<value>(?:(?<=")[^"\\\n]*+(?:\\.[^"\\\n]*+)*+|(?<=')[^'\\\n]*+(?:\\.[^'\\\n]*+)*+
                    |(?<=`)[^`\n]*+))(?P=quote)""", re.VERBOSE | re.ASCII)
NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:[.-]++[\w$]++)*+(?![\w(\[])", re.ASCII)
JOIN = re.compile(r"[ \t]*+(?:(?:\r?\n[ \t]*+)?+\+(?![+=])[ \t]*+(?:\r?\n[ \t]*+)?+|\.[ \t]*+)")
BARE = re.compile(r"""[^\s"'`,;()\[\]{}<>]++""")
CHAINED = re.compile(r"[ \t]*+=(?![=>])")
KEY = re.compile(r"""\[[ \t]*+["']([^"'\n]*+)["'][ \t]*+\]\Z""")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_$][\w.$-]*)\}?\Z", re.ASCII)
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How strongly a part of a name points to a credential.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 0.9,
    "token": 0.8, "credential": 0.8, "credentials": 0.8, "apikey": 0.9, "bearer": 0.7,
    "auth": 0.5, "authorization": 0.7, "signature": 0.4, "salt": 0.4, "key": 0.4,
}
#: Parts that make a neighbouring "key" a credential, and parts that take it back.
STRENGTHEN = {"api", "private", "access", "signing", "encryption", "master", "client", "account"}
WEAKEN = {"public", "length", "len", "size", "count", "type", "name", "url", "uri", "path",
          "file", "header", "field", "id", "expiry", "ttl", "limit", "max", "min", "test"}
PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|-+|changeme|example.*|your.*|placeholder|todo|none"
                         r"|null|true|false|undefined|redacted|dummy.*|sample.*|<.*>|\{\{.*\}\})\Z")
THRESHOLD = 0.5
#: Longer values are judged by their ends and their characters, not as one string.
WHOLE = 256


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    #: Where the secret itself stands, inside the span.
    value_start: int
    value_end: int

    @property
    def label(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind."""
    found = [Span(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LENGTH]
    found += [Span(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """How sensitive the target name is, from its parts."""
    parts = [p.lower() for p in NAME_PART.findall(name.rpartition(".")[2])]
    score = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if score and any(p in STRENGTHEN for p in parts):
        score = min(1.0, score + 0.4)
    return score * 0.4 if any(p in WEAKEN for p in parts) else score


def literal_score(value: str) -> float:
    """How much a literal looks like a credential: long enough, varied, no sentence."""
    return Value.of(Part(0, 0, value, 0, 0)).score()


class Part(NamedTuple):
    """Literals that stand side by side."""

    start: int
    end: int
    value: str
    #: Where the value stands; the quotes of a single literal are no part of the secret.
    value_start: int
    value_end: int


class Value:
    """What a name stands for: literals and earlier values, and what the score needs of them.

    Values refer to values, so joining costs the same however much was joined before.
    """

    __slots__ = ("members", "n", "counts", "head", "tail")

    def __init__(self, members: tuple, n: int, counts: Counter, head: str, tail: str):
        self.members, self.n, self.counts, self.head, self.tail = members, n, counts, head, tail

    @classmethod
    def of(cls, part: Part) -> Value:
        text = part.value
        return cls((part,), len(text), Counter(text), text[:WHOLE], text[-WHOLE:])

    @classmethod
    def joined(cls, values: list[Value]) -> Value:
        if len(values) == 1:
            return values[0]
        counts: Counter = Counter()
        head = tail = ""
        for v in values:
            counts.update(v.counts)
            head = head if len(head) == WHOLE else (head + v.head)[:WHOLE]
            tail = v.tail if v.n >= WHOLE else (tail + v.tail)[-WHOLE:]
        return cls(tuple(values), sum(v.n for v in values), counts, head, tail)

    def placeholder(self) -> bool:
        if self.n <= WHOLE:
            return bool(PLACEHOLDER.match(self.head))
        # a longer one is a run of one sign, or told by its ends
        ends = self.head + self.tail
        return bool(PLACEHOLDER.match(ends)) and (
            len(self.counts) > 2 or len({c.lower() for c in self.counts}) == 1)

    def score(self) -> float:
        n, counts = self.n, self.counts
        if n < 6 or any(c.isspace() for c in counts) or self.placeholder():
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        kinds = sum(any(test(c) for c in counts)
                    for test in (str.islower, str.isupper, str.isdigit))
        kinds += any(not c.isalnum() for c in counts)
        return min(1.0, entropy / 4) * (0.6 if kinds < 2 else 1.0)


def parts_of(values: list[Value]) -> list[Part]:
    """Every literal that the values stand for, once."""
    found, seen = [], set()
    while values:
        value = values.pop()
        if id(value) in seen:
            continue
        seen.add(id(value))
        for member in value.members:
            if isinstance(member, Part):
                found.append(member)
            else:
                values.append(member)
    return found


class Values:
    """Reads values of one text, with the names assigned so far."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, Value] = {}
        # kinds of three quotes of which no pair is left
        self.unclosed: set[str] = set()

    def literal(self, at: int) -> Part | None:
        text = self.text
        for k in range(at, min(at + 3, len(text))):
            if text[k] in "\"'`":
                break
        else:
            return None
        m = None
        quote = text[k:k + 3]
        if quote in ('"' * 3, "'" * 3) and quote not in self.unclosed:
            m = TRIPLE.match(text, at)
            if not m:
                self.unclosed.add(quote)
        m = m or QUOTED.match(text, at)
        return m and Part(at, m.end(), m["value"], *m.span("value"))

    def chain(self, at: int) -> tuple[list[tuple[Value, bool]], int] | None:
        """Values with whether a name stands for them, and the end; None without a literal or a
        known name."""
        parts: list[tuple[Value, bool]] = []
        run: list[Part] = []
        sure, end = False, at

        def close() -> None:
            if len(run) > 1:
                run[:] = [Part(run[0].start, run[-1].end, "".join(p.value for p in run),
                               run[0].start, run[-1].end)]
            parts.extend((Value.of(p), False) for p in run)
            run.clear()

        while True:
            if part := self.literal(at):
                run.append(part)
                sure, end = True, part.end
            elif m := NAME.match(self.text, at):
                close()
                known = self.constants.get(m[0])
                parts += [(known, True)] if known else []
                sure = sure or known is not None
                end = m.end()
            else:
                break
            if not (join := JOIN.match(self.text, end)):
                break
            at = join.end()
        close()
        return (parts, end) if sure else None

    def value(self, at: int) -> tuple[list[tuple[Value, bool]], int] | None:
        """What an assignment's value stands for, and where it ends."""
        found = self.chain(at)
        bare = BARE.match(self.text, at)
        if found and (not bare or found[1] >= bare.end()):
            return found
        if not bare:
            return None
        if (ref := REFERENCE.match(bare[0])) and ref[1] in self.constants:
            return [(self.constants[ref[1]], True)], bare.end()
        raw = bare[0].rstrip(".:")
        return [(Value.of(Part(at, at + len(raw), raw, at, at + len(raw))), False)], bare.end()


def assigned_spans(text: str) -> list[Span]:
    """Secrets found as literals of sensitive names, also through other names."""
    if "=" not in text and ":" not in text:
        return []
    values, found, at = Values(text), set(), 0
    through_names: list[Value] = []
    while m := TARGET.search(text, at):
        at = m.end()
        if not (read := values.value(at)):
            continue
        parts, end = read
        if not parts or parts[-1][1] or text[parts[-1][0].members[0].start] not in "\"'`":
            # a = b = "literal": the next target
            if CHAINED.match(text, end):
                continue
        at = max(end, at)
        name = key[1] if (key := KEY.search(m["keys"])) else m["name"]
        if m["more"] and (before := values.constants.get(m["name"])):
            parts = [(before, True), *parts]
        whole = Value.joined([v for v, _ in parts])
        if not m["keys"]:
            values.constants[m["name"]] = whole
        score = name_score(name)
        if m["last"]:
            # "remark: name = value" reads like a type
            score = max(score, name_score(m["last"]))
            values.constants[m["last"]] = whole
        if score and score * whole.score() >= THRESHOLD:
            through_names += [v for v, known in parts if known]
            found |= {Span(p.start, 3, p.end, p.value_start, p.value_end)
                      for v, known in parts if not known for p in v.members}
    found |= {Span(p.start, 4, p.end, p.value_start, p.value_end)
              for p in parts_of(through_names)}
    return sorted(found)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed patterns, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted({*base, *assigned_spans(text)})


def mask(text: str | None, replacement: str = "[SECRET]") -> str | None:
    """The text with every secret value replaced; names of assignments stay."""
    spans = sorted((s.value_start, s.value_end) for s in scan(text)[1])
    if not spans:
        return text
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], replacement]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text"
                 ) -> DataFrame:
    """Per row: the id, every span as (kind, start, end), and which of them are base spans."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = T.StructType([
        T.StructField("id", rows.schema[id_column].dataType),
        T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()),
        T.StructField("found", T.ArrayType(span))])

    def start():
        def work(piece):
            scans = [scan(t) for t in piece.column("text").to_pylist()]
            counts = [Counter(s.rank for s in base) for base, _ in scans]
            return [piece.column("id"), *([c[k] for c in counts] for k in range(3)),
                    [hashlib.sha256(",".join(s.label for s in base).encode()).hexdigest()
                     for base, _ in scans],
                    [[{"kind": KINDS[s.rank], "start": s.start, "end": s.end} for s in spans]
                     for _, spans in scans]]
        return work

    return (map_text(id_and_text(rows, id_column, text_column), "text", schema, start)
            .withColumnRenamed("id", id_column))


def mask_secrets(rows: DataFrame, text_column: str = "text") -> DataFrame:
    """``rows`` with the secrets in ``text_column`` masked; other columns as they are."""
    schema = rows.schema

    def start():
        def work(piece):
            return [[mask(t) for t in piece.column(i).to_pylist()] if f.name == text_column
                    else piece.column(i) for i, f in enumerate(schema)]
        return work

    return map_text(rows, text_column, schema, start)
