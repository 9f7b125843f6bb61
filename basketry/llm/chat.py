"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

``Template`` declares the states and which role may follow in each, and for
each role the marks before and after its text and whether the text is
trained on.  Rows are dealt by conversation and sorted by turn; the machine
runs over the sorted rows of a partition as they stream past, so a
conversation of any number of turns needs the state of one turn at a time.
Every turn becomes one output row with its segments in order: (text, loss).
The formatted conversation is the concatenation of all its segments.

Texts are escaped reversibly: a control string inside a text gets one more
backslash after its first character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes
``<\\\\/s>``); no other text changes.  A control string has its first character
nowhere else and holds no blank, and marks start and end with a control string or a blank, so none
arises where a text meets a mark, and ``parse`` reads roles and texts back exactly.

A turn out of order, or of a role that the template does not know, is
formatted all the same (an unknown role with its name in the mark) and
reported in ``error``; the machine goes on in the state after that role, or
stays where it is if the role is unknown.

Defined cases: a null text or role counts as empty; rows of a null conversation are one
conversation; rows of the same turn are ordered by role and text, a null turn
first; repeated rows are repeated turns.  Very long texts are one turn each,
whole.  Empty tables give an empty result; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 2_000  # of an output batch


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[OUT] ", " </s>", loss=True),
    })
    #: Marks of a role that is not declared: before its name, between name and text, after the text.
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    #: state -> role -> next state
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })

    def controls(self) -> list[str]:
        marks = [self.begin, *self.other, *(m for t in self.turns.values() for m in (t.before, t.after))]
        return sorted({m.strip(" ") for m in marks})

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls()}
        if any(len(c) < 2 or " " in c or "\\" in c or firsts & set(c[1:]) for c in self.controls()):
            raise ValueError("a control string must have its first character nowhere else, and no blank or backslash")


class Codec:
    """Escapes, formats and reads back by one template."""

    def __init__(self, template: Template):
        self.template = template
        controls = template.controls()
        firsts = "".join(re.escape(c) for c in sorted({c[0] for c in controls}))
        rests = "|".join(re.escape(c[1:]) for c in sorted(controls, key=len, reverse=True))
        self.inside = re.compile(rf"([{firsts}])(\\*)({rests})")
        self.control = re.compile("|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True)))
        self.role_of = {t.before.strip(" "): r for r, t in template.turns.items()}

    def escape(self, text: str) -> str:
        return self.inside.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self.inside.sub(lambda m: m[1] + m[2][1:] + m[3], text)

    def segments(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        t = self.template
        begin = t.begin if first else ""
        turn = t.turns.get(role)
        if turn is None:
            name, middle, after = t.other
            return [(begin + name + self.escape(role) + middle + self.escape(text) + after, False)]
        return [(begin + turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn in a formatted conversation, or in any run of whole turns of one."""
        out: list[tuple[str, str]] = []
        t, at = self.template, 0
        marks = self.control.finditer(formatted)
        for m in marks:
            if m[0] == t.begin:
                at = m.end()
                continue
            if m.start() != at:
                raise ValueError("text between turns")
            name = self.role_of.get(m[0])
            if name is None:  # an undeclared role
                a = m.start() + len(t.other[0])
                z = next(marks)
                name = self.unescape(formatted[a:z.end() - len(t.other[1].strip(" ")) - (len(t.other[1]) - len(t.other[1].lstrip(" ")))])
                a, after = z.start() - (len(t.other[1]) - len(t.other[1].lstrip(" "))) + len(t.other[1]), t.other[2]
            else:
                a, after = m.start() + len(t.turns[name].before), t.turns[name].after
            z = next(marks)
            e = z.end() - len(after)
            out.append((name, self.unescape(formatted[a:e])))
            at = z.end()
        return out


def _strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def format_turns(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, state, error, segments) for every row: conversations in their order of turns, pos from 0.

    ``segments`` is an array of (text, loss); ``error`` is null, or says which role was out of order in which state.
    """
    codec = Codec(template)

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, pos = object(), "start", 0  # the partition's rows come sorted; a conversation spans batches
        for b in batches:
            for some in (b.slice(k, ROWS) for k in range(0, b.num_rows, ROWS)):
                at, states, errors, segments = [], [], [], []
                for c, r, t in zip(some.column(0).to_pylist(), _strings(some.column(2)), _strings(some.column(3))):
                    if c != current:
                        current, state, pos = c, "start", 0
                    after = template.order.get(state, {}).get(r)
                    errors.append(None if after else f"{r or 'no role'} after {state}")
                    segments.append([{"text": x, "loss": loss} for x, loss in codec.segments(r, t, pos == 0)])
                    state = after or (r if r in template.order else state)
                    at.append(pos)
                    states.append(state)
                    pos += 1
                kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(at, pa.int64()), pa.array(states, pa.string()), pa.array(errors, pa.string()), pa.array(segments, kind)], ["conv_id", "pos", "state", "error", "segments"])

    rows = turns.select(conv_id, turn, role, text).toDF("conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema[conv_id].dataType.simpleString()
    return rows.mapInArrow(machine, f"conv_id {kind}, pos bigint, state string, error string, segments array<struct<text: string, loss: boolean>>")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of every conversation, from the segments alone: one row (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid).

    ``formatted`` is the frame of ``format_turns``, its rows in that order.  Digests grow turn by turn, so a
    conversation is never held whole.
    """
    codec = Codec(template)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        none = object()
        current, done = none, []
        kind = None

        def flush():
            done.append((current, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))

        def batch():
            columns = list(zip(*done))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            kind = b.schema.field("conv_id").type
            for some in (b.slice(k, ROWS) for k in range(0, b.num_rows, ROWS)):
                for c, error, segments in zip(some.column("conv_id").to_pylist(), some.column("error").to_pylist(), some.column("segments").to_pylist()):
                    if c != current:
                        if current is not none:
                            flush()
                        current, n, loss_chars, chars, valid = c, 0, 0, 0, True
                        whole, loss = hashlib.sha256(), hashlib.sha256()
                    valid &= error is None
                    piece = "".join(s["text"] for s in segments)
                    chars += len(piece)
                    for role, text in codec.parse(piece):
                        n += 1
                        whole.update(f"{role}\n{text}\n".encode())
                    for s in segments:
                        if s["loss"]:
                            text = codec.unescape(s["text"])
                            loss_chars += len(text)
                            loss.update(text.encode())
                if done:
                    yield batch()
                    done.clear()
        if current is not none:
            flush()
            yield batch()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")


PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def _sql(template: Template) -> str:
    """Reference SQL; the marks' lengths and the control strings come from the template."""
    controls = template.controls()
    firsts = "".join("\\" + c for c in sorted({c[0] for c in controls}))
    rests = "|".join(re.sub(r"([\[\]/])", r"\\\1", c[1:]) for c in sorted(controls, key=len, reverse=True))
    marks = " ".join(f"WHEN '{r}' THEN {len(t.before) + len(t.after)}" for r, t in template.turns.items())
    trained = ", ".join(f"'{r}'" for r, t in template.turns.items() if t.loss)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
),
d AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS prev,
    length(regexp_replace(t, '([{firsts}])(\\\\*)({rests})', '\\1#\\2\\3', 'g')) + CASE role {marks} END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role IN ({trained})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role IN ({trained})), '')) AS loss_sha256,
  CAST({len(template.begin)} + sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN prev IS NULL WHEN 'user' THEN prev IS DISTINCT FROM 'user' WHEN 'assistant' THEN prev IS NOT DISTINCT FROM 'user' ELSE false END) AS valid
FROM d GROUP BY conv_id
"""


SQL = _sql(Template())


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_turns(turns.unionByName(probe)))
