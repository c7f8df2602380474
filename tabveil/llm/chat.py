"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Precedes a digit in escaped texts; itself written with a 0 behind it.
ESCAPE = "␛"


#: The state after a turn that the machine doesn't allow; nothing leaves it.
ERROR = "error"


@dataclass(frozen=True)
class Template:
    """What surrounds the text of each kind of turn, which kinds carry loss, and which role may follow which.

    other is for roles without an entry; {role} stands for the escaped role. Control strings must not begin
    with a character that they hold again at a place where they would overlap themselves, nor hold ESCAPE.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>\n")}
    )
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>\n", "\n<</TEXT>>\n")
    loss: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; a missing entry leads to ERROR.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    #: state -> the kind of turn that is emitted on entering it; on ERROR the role itself is the kind.
    emits: dict[str, str] = field(default_factory=lambda: {"primed": "system", "asked": "user", "answered": "assistant"})
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        marks = [m for pair in self.marks.values() for m in pair] + [*self.other]
        return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """text without control strings; unescape() restores it."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + "1" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit("")), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _segments(turn: Column, state: Column, template: Template) -> Column:
    """(text, loss, state) of the segments that the machine emits on entering state by a turn: mark, escaped text, end."""
    part = lambda x, loss=False: F.struct(x.alias("text"), F.lit(loss).alias("loss"), state.alias("state"))
    said = escape(turn.text, template)
    a, b, c = template.other
    # a null role is told from one that is the word null by a mark of its own
    role = F.coalesce(F.concat(F.lit("="), escape(turn.role, template)), F.lit("-"))
    kinds = {name: F.array(part(F.lit(before)), part(said, name in template.loss), part(F.lit(after))) for name, (before, after) in template.marks.items()}
    out = F.array(part(F.concat(F.lit(a), role, F.lit(b))), part(said), part(F.lit(c)))
    for name, emitted in kinds.items():
        out = F.when((state == ERROR) & (turn.role == name), emitted).otherwise(out)
    for entered, name in template.emits.items():
        out = F.when(state == entered, kinds[name]).otherwise(out)
    return out


def _states(turns: Column, template: Template) -> Column:
    """The state of the machine after each turn."""

    def step(seen: Column, turn: Column) -> Column:
        state, out = F.element_at(seen, -1), F.lit(ERROR)
        for source, edges in template.machine.items():
            for role, target in edges.items():
                out = F.when((state == source) & turn.role.eqNullSafe(role), target).otherwise(out)
        return F.array_append(seen, out)

    scanned = F.aggregate(turns, F.array(F.lit("start")), step)
    return F.slice(scanned, F.lit(2), F.greatest(F.size(turns), F.lit(0)))


def _mask(segments: Column) -> Column:
    """The runs of the joined segments, in code points, end exclusive, that carry loss."""
    run = "struct<start: bigint, end: bigint>"

    def step(seen: Column, s: Column) -> Column:
        end = seen.at + F.char_length(s.text)
        runs = F.when(s.loss, F.array_append(seen.runs, F.struct(seen.at.alias("start"), end.alias("end")).cast(run))).otherwise(seen.runs)
        return F.struct(end.alias("at"), runs.alias("runs"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{run}>").alias("runs"))
    return F.aggregate(segments, first, step, lambda seen: seen.runs)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss, state>>, formatted, mask array<struct<start, end>>.

    One row for each conversation of turns(conv_id, turn, role, text), ordered by turn, ties by role and text; null turns
    come first, and repeated rows stay. A null text is empty. The machine reads the roles in this order; each state that it
    enters emits its segments. valid tells whether it ends in a final state; from a turn on that it doesn't allow it is in
    ERROR, and turns are emitted by their role. mask has the code points of formatted that carry loss. Null conv_ids are one
    conversation. Other columns are ignored; an empty table gives an empty table. A conversation is one row, so its text
    must fit one.
    """
    turn = F.struct("turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn), lambda a, b: _compare(a, b))
    found = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    # each step is computed from a plain column, not from the aggregate again
    found = found.select("conv_id", "turns", _states(F.col("turns"), template).alias("states"))
    valid = F.element_at("states", -1).isin(*template.final)
    emitted = F.transform("turns", lambda t, i: _segments(t, F.get("states", i), template))
    found = found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"), F.flatten(emitted).alias("segments"))
    return found.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), "")).withColumn("mask", _mask(F.col("segments")))


def _compare(a: Column, b: Column) -> Column:
    """Turn, role, text; nulls first."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> from a formatted conversation: the inverse of format_conversations."""
    a, b, c = template.other
    bodies = [f"{_quoted(x)}(?:.*?){_quoted(y)}" for x, y in template.marks.values()] + [f"{_quoted(a)}(?:.*?){_quoted(b)}(?:.*?){_quoted(c)}"]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(bodies)), F.lit(0))

    def turn(x: Column) -> Column:
        rest = F.substr(x, F.lit(len(a) + 1))
        cut = F.instr(rest, b)
        named = F.substr(rest, F.lit(1), cut - 1)
        role = F.when(F.startswith(named, F.lit("=")), unescape(F.substr(named, F.lit(2))))
        body = F.substr(rest, cut + len(b), F.char_length(rest) - cut - len(b) - len(c) + 1)
        out = F.struct(role.alias("role"), unescape(body).alias("text"))
        for name, (before, after) in template.marks.items():
            inner = F.substr(x, F.lit(len(before) + 1), F.char_length(x) - len(before) - len(after))
            out = F.when(F.startswith(x, F.lit(before)), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    return F.transform(found, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, in order."""
    return F.transform(mask, lambda m: unescape(F.substr(formatted, (m.start + 1).cast("int"), (m.end - m.start).cast("int"))))
