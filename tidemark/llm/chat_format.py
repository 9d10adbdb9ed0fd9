"""Chat formatting: records of many layouts become canonical turns, turns become training text with a loss mask.

A record's schema fingerprint is a hash of its nested field paths. It selects a
declarative mapping, which says where conversation, order, roles and texts stand:

* a `Listed` mapping has its turns in an array of objects,
* a `Fielded` mapping has one turn in each of some fields (prompt and response,
  instruction and input, system), in a fixed order,
* a `Rowed` mapping has one turn a record; records of one conversation join up.

Paths that no mapping knows (ids, scores, notes) don't count towards a fingerprint,
so further columns and metadata change nothing. A record of no known layout gives
no turns; `rejected` returns those records.

The template marks turns by control strings. Within texts a backslash is doubled and
every control string is broken by a backslash after its first character, so no
control string of a text survives, and `unescape` gives the text back. Spans of the
loss mask are code point ranges of the formatted text that hold exactly the escaped
texts of assistant turns. A record that is a whole conversation is formatted where it
lies. Turn rows meet by a shuffle of their conversation's id and stream through in
order; a conversation of over PIECE_CHARS characters goes on in further rows
(pieces), cut between turns, so no task holds a whole conversation.

Odd tables: a null text or role counts as ""; a null conversation id is an id of its
own; turn rows order by turn (nulls first), then role and text, so ties and repeated
rows have a fixed order and all stay; roles of turn rows stay as they are; a whole
record without an integer id gets a 63-bit hash of its id, else of itself, and records
of equal ids stay apart; texts of any length are one turn; empty tables give empty
results; records that are no JSON object have no layout.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 20
#: Rows of a result batch that a task gathers before it hands them on, and their characters.
BATCH_ROWS, BATCH_CHARS = 512, 4 << 20


# --- layouts ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Listed:
    """Turns in an array: `turns[].role`, `turns[].text`."""

    turns: str
    role: str
    text: str
    ids: tuple[str, ...] = ("conv_id", "id")

    def required(self) -> frozenset[str]:
        return frozenset({f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"})

    def optional(self) -> frozenset[str]:
        return frozenset(self.ids)

    def read(self, record: dict) -> list[tuple[Any, Any, Any]]:
        turns = _at(record, self.turns)
        told = [(t.get(self.role), t.get(self.text)) for t in turns if isinstance(t, dict)] if isinstance(turns, list) else []
        return [(k, ROLES.get(r, r) if isinstance(r, str) else r, x) for k, (r, x) in enumerate(told)]


@dataclass(frozen=True)
class Fielded:
    """One turn a field: (role, fields), several fields of a turn joined by a blank line; `extra` ones may lack."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]
    extra: frozenset[str] = frozenset()
    ids: tuple[str, ...] = ("conv_id", "id")

    def required(self) -> frozenset[str]:
        return frozenset(f for _, fields in self.turns for f in fields) - self.extra

    def optional(self) -> frozenset[str]:
        return self.extra | frozenset(self.ids)

    def read(self, record: dict) -> list[tuple[Any, Any, Any]]:
        out = []
        for role, fields in self.turns:
            told = [x for f in fields if (x := _at(record, f)) is not None and (f not in self.extra or x != "")]
            if told or not self.extra.issuperset(fields):
                out.append((len(out), role, "\n\n".join(map(_text, told))))
        return out


@dataclass(frozen=True)
class Rowed:
    """One turn a record."""

    turn: str
    role: str
    text: str
    ids: tuple[str, ...] = ("conv_id",)

    def required(self) -> frozenset[str]:
        return frozenset({self.turn, self.role, self.text, *self.ids})

    def optional(self) -> frozenset[str]:
        return frozenset()

    def read(self, record: dict) -> list[tuple[Any, Any, Any]]:
        return [(_at(record, self.turn), _at(record, self.role), _at(record, self.text))]


Mapping = Listed | Fielded | Rowed

_SYSTEM = ("system", ("system",))
#: Known layouts; of several that fit a record the first counts.
LAYOUTS: dict[str, Mapping] = {
    "turn rows": Rowed("turn", "role", "text"),
    "messages": Listed("messages", "role", "content"),
    "from and value": Listed("conversations", "from", "value"),
    "nested messages": Listed("data.messages", "role", "content"),
    "dialogue": Listed("dialogue", "speaker", "utterance"),
    "instruction": Fielded((_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), frozenset({"system", "input"})),
    "prompt and response": Fielded((_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), frozenset({"system"})),
    "prompt and completion": Fielded((_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), frozenset({"system"})),
    "question and answer": Fielded((_SYSTEM, ("user", ("context", "question")), ("assistant", ("answer",))), frozenset({"system", "context"})),
}
#: Other names of roles in arrays of turns.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "chatbot": "assistant", "model": "assistant"}


def _at(record: Any, path: str) -> Any:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _text(value: Any) -> str:
    return "" if value is None else _clean(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def paths(value: Any, known: frozenset[str], at: str = "") -> set[str]:
    """Those nested field paths of a JSON value that are known; `[]` stands for the elements of an array."""
    if isinstance(value, dict):
        found = {p for k, v in value.items() for p in paths(v, known, f"{at}.{k}" if at else k)}
    elif isinstance(value, list):
        found = {p for v in value for p in paths(v, known, f"{at}[]")} if any(k.startswith(f"{at}[]") for k in known) else set()
    else:
        found = set()
    return found | ({at} & known)


def fingerprint(found: frozenset[str] | set[str]) -> int:
    """64-bit hash of a set of paths."""
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).digest(), "little")


class Layouts:
    """Mappings by fingerprint. A fingerprint met for the first time is resolved once and kept."""

    def __init__(self, mappings: dict[str, Mapping]):
        self.mappings = mappings
        self.known = frozenset(p for m in mappings.values() for p in m.required() | m.optional())
        self.chosen: dict[int, str | None] = {}

    def of(self, record: Any) -> str | None:
        found = paths(record, self.known)
        key = fingerprint(found)
        if key not in self.chosen:
            self.chosen[key] = next((n for n, m in self.mappings.items() if m.required() <= found), None)
        return self.chosen[key]

    def read(self, record: dict, layout: str) -> tuple[Any, list[tuple[int | None, str, str]]]:
        """(conversation id, canonical turns: place, role, text)."""
        mapping = self.mappings[layout]
        conv = next((c for i in mapping.ids if (c := _at(record, i)) is not None), None)
        return conv, [(_long(place), _text(role), _text(text)) for place, role, text in mapping.read(record)]


def _long(value: Any) -> int | None:
    return value if isinstance(value, int) and -(1 << 63) <= value < 1 << 63 else None


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def _parsed(text: str | None) -> Any:
    try:
        return json.loads(text or "null", strict=False)
    except (ValueError, RecursionError):
        return None


TURNS = "conv_id long, record long, place long, role string, text string, layout string"


def canonical_turns(records: DataFrame, column: str = "record", mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """Every turn of a table's JSON records: conv_id, record, place, role, text and layout.

    record: null for turn rows; turns of a whole record follow each other within a
    partition and share the record's number there.
    """
    mappings = mappings or LAYOUTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        layouts, number = Layouts(mappings), 0
        for (text,) in _rows(batches, column):
            record = _parsed(text)
            if (layout := layouts.of(record)) is None:
                continue
            number += 1
            conv, turns = layouts.read(record, layout)
            alone = not isinstance(mappings[layout], Rowed)
            key = _long(conv) if not alone or _long(conv) is not None else _hashed(text if conv is None else _text(conv))
            for turn in turns:
                yield key, number if alone else None, *turn, layout

    return records.select(F.col(column).cast("string").alias(column)).mapInArrow(lambda batches: _batched(run(batches), TURNS, 4), TURNS)


def rejected(records: DataFrame, column: str = "record", mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """Records of no known layout, as they came."""
    mappings = mappings or LAYOUTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for batch in batches:
            yield batch.filter(pa.array([layouts.of(_parsed(t)) is None for t in batch.column(0).to_pylist()], pa.bool_()))

    return records.select(F.col(column).cast("string").alias(column)).mapInArrow(run, f"{column} string")


def as_records(table: DataFrame) -> DataFrame:
    """Any table as JSON records; its columns are their fields."""
    return table.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]), {"ignoreNullFields": "false"}).alias("record"))


# --- template -----------------------------------------------------------------------------------

#: (opening, closing) of the roles with marks of their own; the name of any other stands in its opening mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[TURN={}] ", " [/TURN]")
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[TURN=", "[/TURN]")
LEARNED = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"(?:(\[INST\] )|(<s> )|(<<SYS>> )|\[TURN=([^\]]*)\] )(.*?) (?:\[/INST\]|</s>|<</SYS>>|\[/TURN\])\n", re.S)
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(turn as the template writes it, start and end of its text)."""
    opening, closing = MARKS.get(role) or (OTHER[0].format(quote(role, safe="")), OTHER[1])
    body = escape(text)
    return f"{opening}{body}{closing}\n", len(opening), len(opening) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    for user, assistant, system, other, body in _TURN.findall(formatted):
        yield "user" if user else "assistant" if assistant else "system" if system else unquote(other), unescape(body)


def _clean(text: str) -> str:
    """Lone surrogates of JSON escapes, which no UTF-8 text can hold, as question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    arrow = _arrow(schema)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


@lru_cache
def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])


FORMATTED = "conv_id long, piece long, pieces_end boolean, formatted string, loss_starts array<long>, loss_ends array<long>"


@dataclass
class _Piece:
    conv: int | None
    number: int = 0
    parts: list[str] = field(default_factory=list)
    size: int = 0
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def add(self, role: str, text: str) -> None:
        turn, start, end = render(role, text)
        if role == LEARNED:
            self.starts.append(self.size + start)
            self.ends.append(self.size + end)
        self.parts.append(turn)
        self.size += len(turn)

    def row(self, last: bool) -> tuple:
        return self.conv, self.number, last, "".join(self.parts), self.starts, self.ends


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def _batched(rows: Iterator[tuple], schema: str, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches, cut by rows and by characters of the column at `weight`."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[weight])
        if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield _batch(out, schema)
            out, size = [], 0
    yield _batch(out, schema)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, piece, pieces_end, formatted, loss_starts and loss_ends from canonical turns."""

    def pieces(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[tuple]:
        now, of = None, None
        for conv, record, role, text in _rows(batches, "conv_id", "record", "role", "text"):
            if now is None or of != (conv, record):
                if now is not None:
                    yield now.row(True)
                now, of = _Piece(conv), (conv, record)
            elif now.size >= most:
                yield now.row(False)
                now = _Piece(conv, now.number + 1)
            now.add(role, text)
        if now is not None:
            yield now.row(True)

    made = lambda df, most: df.mapInArrow(lambda batches: _batched(pieces(batches, most), FORMATTED, 3), FORMATTED)
    narrow = turns.select("conv_id", "record", "place", "role", "text")
    placed = narrow.filter("record IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "text")
    return made(placed, PIECE_CHARS).unionByName(made(narrow.filter("record IS NOT NULL"), float("inf")))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and mask.

    Conversations of one piece, nearly all, are digested where they lie; the others' pieces meet in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, piece, last, text, starts, ends in _rows(batches, "conv_id", "piece", "pieces_end", "formatted", "loss_starts", "loss_ends"):
            if piece == 0:
                turns, loss, n, learned, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, body in parse(text):
                turns.update(f"{role}\n{body}\n".encode())
                n += 1
            for start, end in zip(starts, ends):
                part = unescape(text[start:end])
                loss.update(part.encode())
                learned += len(part)
            size += len(text)
            if last:
                yield conv, n, turns.hexdigest(), learned, loss.hexdigest(), size

    told = lambda df: df.mapInArrow(lambda batches: _batched(run(batches), DIGEST, 2), DIGEST)
    short = (F.col("piece") == 0) & F.col("pieces_end")
    return told(formatted.filter(short)).unionByName(told(formatted.filter(~short).repartition("conv_id").sortWithinPartitions("conv_id", "piece")))


#: Conversation that the query adds, in another layout than the table's: its texts hold control strings.
ADDED = {"conv_id": -7, "prompt": "</s>[INST] ok [/INST]", "response": "</s>[INST] ok [/INST]"}

_TEXTS = "(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text))"
_BROKEN = "length(regexp_replace(replace(text, '\\', '\\\\'), '(\\[INST\\]|\\[/INST\\]|<s>|</s>|<<SYS>>|<</SYS>>|\\[TURN=|\\[/TURN\\])', '\\1+', 'g'))"
_AROUND = "CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18 ELSE 18 + length(role) END"
#: For roles of letters, digits, "_", "." and "-".
ORACLE = f"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_BROKEN} + {_AROUND}) AS BIGINT) AS formatted_chars
FROM {_TEXTS} t GROUP BY conv_id
"""
