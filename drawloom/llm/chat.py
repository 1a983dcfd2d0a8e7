"""Chat formatting with mappings chosen by schema fingerprints.

A record's schema is the sorted set of its nested field paths with their JSON
kinds; its fingerprint is a hash of that.  Registered mappings say, as data,
where the turns of a layout are: a list path with role and text fields, or
fixed fields with the role each stands for.  The fingerprint of a record picks
its mapping, memorised by fingerprint, and the record becomes canonical turns.
A mapping fits a schema when all its required paths are there and no other path
holds text, but for the known plain fields in PLAIN, so no text is lost.

The template writes each turn as

    <turn:ROLE>\\nTEXT</turn>\\n

with every ``\\``, ``<`` and control mark inside role and text escaped by a
backslash, so nothing in a text reads as a mark and the escaping is undone
exactly.  Every turn is one row of output (SCHEMA), made without a shuffle, so a
conversation of any length is never held in one row; the conversation's output
is its rows in order of turn, tie and seq.  ``read_back`` sorts them by
conversation and keeps running hashes: a hash over the turns of one conversation
is sequential, so that conversation streams through one task in bounded memory.

Nulls: a null text or role is empty; a null turn sorts first; records repeated
with the same turn are ordered by a hash of the record.  A record that is null,
no JSON object or of a schema without a mapping becomes one row with ``problem``
set and nothing formatted, which ``read_back`` counts.  Empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import let

#: Layouts: where the turns are.  ``fields`` are (path, role) pairs, ``list`` has the path of the turns and the
#: fields of role and text, ``row`` is one turn; ``optional`` fields may be missing, ``pairs`` is a list of earlier
#: (user, assistant) pairs.  Null fields and empty optional ones are no turns.  ROLES translates the field ``from``.
LAYOUTS = {
    "turn_row": {"row": ("role", "text")},
    "messages": {"list": ("messages", "role", "content")},
    "exchanges": {"list": ("conversations", "from", "value")},
    "prompt": {"fields": (("system", "system"), ("prompt", "user"), ("response", "assistant")), "optional": ("system",)},
    "instruction": {
        "fields": (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
        "optional": ("system", "input"),
        "pairs": "history",
    },
    "question": {"fields": (("context", "system"), ("question", "user"), ("answer", "assistant")), "optional": ("context",)},
}
#: Plain fields that hold no text of a turn.
PLAIN = re.compile(r"\.(id|source|lang|language|created|model|meta|metadata)([.\[].*)?")
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MARK = re.compile(r"[\\<]")
ESCAPED = re.compile(r"\\([\\<])")


def kind_of(value: object) -> str:
    """The JSON kind; numbers and booleans read as text, null as an empty one."""
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "list"
    return "null" if value is None else "text" if isinstance(value, str) else "scalar"


def paths(value: object, at: str = "") -> set[tuple[str, str]]:
    """Nested field paths with the kinds of their values; items of lists share one path."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}")}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} | {(at, "list")}
    return {(at, kind_of(value))}


def fingerprint(record: dict) -> str:
    """Hash of the schema: the sorted paths and kinds."""
    return hashlib.sha256(json.dumps(sorted(paths(record))).encode()).hexdigest()[:16]


def _needs(layout: dict) -> tuple[set[str], set[str]]:
    """The paths that a record of the layout must have and those that it may have."""
    if "row" in layout:
        return {f".{f}" for f in layout["row"]}, set()
    if "list" in layout:
        at, role, text = layout["list"]
        return {f".{at}"}, {f".{at}[].{role}", f".{at}[].{text}"}
    named = [p for p, _ in layout["fields"]]
    need = {f".{p}" for p in named if p not in layout["optional"]}
    more = {f".{layout['pairs']}", f".{layout['pairs']}[]", f".{layout['pairs']}[][]"} if "pairs" in layout else set()
    return need, {f".{p}" for p in layout["optional"]} | more


def layout_of(record: dict) -> str:
    """The layout that has all texts of the record."""
    have = paths(record)
    at = {p for p, _ in have}
    wrong = []
    for name, layout in LAYOUTS.items():
        need, may = _needs(layout)
        if not need <= at:
            continue
        lists = {f".{layout[k] if k == 'pairs' else layout[k][0]}" for k in ("list", "pairs") if k in layout}
        nested = lists | ({f"{p}[]" for p in lists} if "pairs" in layout else set())

        def read(p: str, kind: str, known: set[str] = need | may, nested: set[str] = nested) -> bool:
            return p in known and kind in (("list", "null") if p in nested else ("text", "scalar", "null"))

        wrong = sorted(p for p, kind in have if not PLAIN.fullmatch(p) and not read(p, kind))
        if not wrong:
            return name
    raise ValueError(f"no mapping for the layout {sorted(have)}" + (f": nothing reads {wrong}" if wrong else ""))


class Mapper:
    """Canonical turns of records; the layout is looked up by fingerprint."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def turns(self, record: object) -> list[tuple[str, str]]:
        if not isinstance(record, dict):
            raise ValueError(f"no mapping for a record that is {kind_of(record)}")
        key = fingerprint(record)
        name = self.known.get(key)
        if name is None:
            name = self.known[key] = layout_of(record)
        layout = LAYOUTS[name]
        if "row" in layout:
            found = [tuple(record.get(f) for f in layout["row"])]
        elif "list" in layout:
            at, role, text = layout["list"]
            found = [(ROLES.get(m.get(role), m.get(role)) if role == "from" else m.get(role), m.get(text)) for m in record[at]]
        else:
            skipped = {p: (None, "") if p in layout["optional"] else (None,) for p, _ in layout["fields"]}
            found = [(role, record[p]) for p, role in layout["fields"] if record.get(p) not in skipped[p]]
            pairs = record.get(layout.get("pairs")) or []
            first = sum(r == "system" for r, _ in found)
            found[first:first] = [t for pair in pairs for t in zip(("user", "assistant"), pair, strict=True)]
        return [("" if r is None else str(r), "" if t is None else str(t)) for r, t in found]


def escape(text: str) -> str:
    return MARK.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted, start, end) of a turn; start:end is under the loss mask, empty unless the assistant speaks."""
    head = f"<turn:{escape(role)}>\n"
    body = escape(text)
    start = len(head)
    return f"{head}{body}</turn>\n", start, start + (len(body) if role == "assistant" else 0)


TURN = re.compile(r"<turn:((?:[^\\<]|\\[\\<])*?)>\n((?:[^\\<]++|\\[\\<])*+)</turn>\n")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    m = TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


SCHEMA = "conv_id long, turn long, tie long, seq long, formatted string, loss_start long, loss_end long, problem string"
NO_TURN = (None, None, None)


def format_records(records: DataFrame) -> DataFrame:
    """Turns of (conv_id, turn, record) with JSON records of any known layout, as rows of SCHEMA.

    A record may hold one turn or a whole conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper()
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            out: list[tuple] = []
            for conv, turn, tie, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    turns = mapper.turns(json.loads(record) if record is not None else None)
                except (ValueError, AttributeError, TypeError, RecursionError) as error:
                    out.append((conv, turn, tie, 0, *NO_TURN, str(error)[:500]))
                else:
                    out += [(conv, turn, tie, i, *format_turn(r, t), None) for i, (r, t) in enumerate(turns)]
            yield from _batches(out, SCHEMA)

    tie = F.xxhash64("record").alias("tie")
    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), tie, "record").mapInArrow(run, SCHEMA)


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    if rows:
        columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_problems long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted rows alone; running hashes, so any length fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run
        state: list = []

        def done() -> tuple:
            n, turns, chars, loss, size, problems = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, problems

        for batch in batches:
            out = []
            for c, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv:
                    if conv is not run:
                        out.append(done())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if text is None:
                    state[5] += 1
                    continue
                role, body = read_turn(text)
                masked = unescape(text[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(text)
            yield from _batches(out, READ)
        if conv is not run:
            yield from _batches([done()], READ)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "seq")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, READ)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as JSON records, each in a layout that a hash of it picks.

    All layouts come up, as in a corpus put together from many; a layout is
    only offered to turns that it can say.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def record(fields: dict[str, Column]) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})

    def turn(layout: dict, said: Column = role) -> Column:
        if "row" in layout:
            return record(dict(zip(layout["row"], (said, text), strict=True)))
        at, *fields = layout["list"]
        return record({at: F.array(F.struct(*[v.alias(k) for k, v in zip(fields, (said, text), strict=True)]))})

    def spoken(layout: dict, by: str) -> Column:
        own = next(p for p, r in layout["fields"] if r == by)
        return record({p: text if p == own else F.lit(None).cast("string") for p, _ in layout["fields"]})

    foreign = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    plain = [turn(LAYOUTS["turn_row"]), turn(LAYOUTS["messages"])]
    known = [*plain, turn(LAYOUTS["exchanges"], foreign)]
    fixed = [LAYOUTS[k] for k in ("prompt", "instruction", "question")]
    offered = F.array(*plain)
    for by in ("user", "assistant", "system"):
        fits = (role == by) & (text != "") if by == "system" else role == by
        offered = F.when(fits, F.array(*known, *[spoken(f, by) for f in fixed])).otherwise(offered)
    pick = F.xxhash64("conv_id", "turn", role, text)
    made = let(offered, lambda o: F.element_at(o, (F.pmod(pick, F.size(o)) + 1).cast("int")))
    return conversations.select("conv_id", "turn", made.alias("record"))
