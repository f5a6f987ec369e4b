"""Chat formatting by schema fingerprints.

A record is a JSON document in any known layout. The set of its nested field paths is hashed; the hash selects a
declarative mapping (`Layout`) that turns the record into canonical turns (role, text). Turns are then written between
control strings, with control strings inside roles and texts escaped reversibly, and can be read back with the spans that
the loss covers.

Escaping: `<|` in a text becomes `<\\|`, and every run of backslashes between `<` and `|` grows by one, so that `<|` never
stands inside an escaped text and the inverse is exact.

Defined results: null roles and texts count as empty; a record of an unknown layout, or one that is no JSON object, gets
null turns and keeps its fingerprint for review; an empty list of turns gives an empty string; turns of equal rank are
ordered by role, then text; rows without a conv_id form one conversation; other columns pass through `canonical_turns`.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|newline|>"


@dataclass(frozen=True)
class Layout:
    """How a record becomes turns: `parts` name fields by role, `each` a list of messages ("" for the record itself)."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        if self.each is None:
            return {f".{f}" for _, fields in self.parts for f in fields}
        inside = f".{self.each}[]" if self.each else ""
        return {f"{inside}.{self.role}", f"{inside}.{self.text}"} | {f".{f}" for _, fields in self.parts for f in fields}

    def turns(self, record: dict) -> list[tuple[str, str]]:
        out = []
        for role, fields in self.parts:
            text = "\n\n".join(x for f in fields if (x := _text(record.get(f))))
            if text or not all(f in self.optional for f in fields):
                out.append((role, text))
        for m in [] if self.each is None else record[self.each] if self.each else [record]:
            role = _text(m.get(self.role))
            out.append((self.roles.get(role, role), _text(m.get(self.text))))
        return out


LAYOUTS = (
    Layout("turn", each="", text="text"),
    Layout("messages", each="messages", parts=(("system", ("system",)),), optional=("system",)),
    Layout("from-value", each="conversations", role="from", text="value", parts=(("system", ("system",)),), optional=("system",), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt-completion", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt-response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question-answer", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def field_paths(value, at: str = "") -> Iterator[str]:
    """The paths of the leaves; list items share one path."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}")
    elif isinstance(value, list) and value:
        for v in value:
            yield from field_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha1("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def mappings(layouts: Iterable[Layout] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint to layout, with an entry for each choice of a layout's optional fields."""
    out = {}
    for x in layouts:
        for k in range(len(x.optional) + 1):
            for absent in itertools.combinations(x.optional, k):
                out[fingerprint(x.paths() - {f".{f}" for f in absent})] = x
    return out


def read_record(text: str | None, known: dict[str, Layout]) -> tuple[str, str | None, list | None]:
    try:
        record = json.loads(text) if text is not None else None
    except ValueError:
        record = None
    if not isinstance(record, dict):
        return fingerprint([]), None, None
    layout = known.get(key := fingerprint(field_paths(record)))
    return (key, layout.name, layout.turns(record)) if layout else (key, None, None)


def canonical_turns(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds schema(fingerprint, layout, turns) for the JSON column."""
    known = mappings(layouts)

    @F.pandas_udf("fingerprint string, layout string, turns array<struct<role string, text string>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [read_record(t, known) for t in texts]
        return pd.DataFrame({"fingerprint": [r[0] for r in rows], "layout": [r[1] for r in rows], "turns": [None if r[2] is None else [{"role": a, "text": b} for a, b in r[2]] for r in rows]})

    return records.withColumn("schema", read(F.col(column)))


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape(role).replace(chr(10), NEWLINE)}\n{escape(text)}{END}\n"


def parse_formatted(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and the span of the escaped text in it."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        assert formatted.startswith(START, at) and formatted.startswith("\n", end + len(END))
        yield unescape(formatted[at + len(START) : line].replace(NEWLINE, "\n")), unescape(formatted[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def loss_spans(formatted: str, roles: frozenset[str] = frozenset(["assistant"])) -> list[tuple[int, int]]:
    return [(a, b) for role, _, a, b in parse_formatted(formatted) if role in roles]


def formatted(turns: Column) -> Column:
    """The formatted text of an array of turns (null for null)."""

    @F.pandas_udf("string")
    def put(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else "".join(format_turn(t["role"] or "", t["text"] or "") for t in x) for x in lists], dtype=object)

    return put(turns)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """What reading back yields by conversation, for pieces(conv_id, turn, role, text, formatted) of one or more turns each.

    The digests of a conversation run over its turns in order, so one task reads them, as a sorted stream: it holds one
    batch of rows and two running digests, however long the conversation.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []

        def close():
            if state is not None:
                rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse_formatted(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                    if role == "assistant":
                        state[3] += len(body)
                        state[4].update(body.encode())
                state[5] += len(text)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        close()
        yield _batch(rows)

    ordered = pieces.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
    return ordered.mapInArrow(digest, DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def mixed_records(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with record, the turn as JSON in one of three layouts by conv_id, as corpora of several origins have them.

    A role that the from-value layout would rename is left to the messages layout.
    """
    role, text = F.col("role"), F.col("text")
    given = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    layout = F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(0))
    messages = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    values = F.to_json(F.struct(F.array(F.struct(given.alias("from"), text.alias("value"))).alias("conversations")))
    record = F.when(layout == 0, F.to_json(F.struct("role", "text"))).when((layout == 1) | role.isin("human", "gpt"), messages).otherwise(values)
    return rows.withColumn("record", record)


def format_rows(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), one turn each, with schema and formatted piece; pieces in order are the conversation.

    Each turn is a record of the layout that its conversation came in; its fingerprint alone selects how it is read.
    """
    named = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    read = canonical_turns(mixed_records(named))
    return read.withColumn("formatted", formatted(F.col("schema.turns"))).drop("record")
