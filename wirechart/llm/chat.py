"""Chat formatting: records of any known layout become canonical turns, turns become one marked text with a loss mask.

A layout is known by its fingerprint, a hash of the record's nested field paths without types of leaves and without
fields that say nothing about the layout (``OPTIONAL``). ``Mapping`` says declaratively where turns are found: a list of
messages, or single fields each with a role. A text may be a string or a list of parts with a text each; null is an
empty text, and the turn stays. Only native expressions are used.

Escaping: inside a text, a control string gets a backslash after its first character, and one that already looks like
that gets one more. So no control string is left in a text, and taking one backslash away restores it.

Null texts and roles are empty; turns are ordered by turn, role and text, so ties and repeated rows have one order;
a null id forms a conversation of its own; unknown layouts give no turns and are listed by ``unknown_layouts``. Texts of
any length are formatted whole, within the size of a variant (128 MiB a conversation). Empty tables give empty results,
and columns of other names pass through, but for those that a step adds, which replace theirs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_TAILS = r"(s>|INST\]|/INST\]|/s>)"
_TURN = "array<struct<role: string, text: string>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, "$1$2$3")


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted paths of a schema's leaves; ``[]`` stands for the items of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Fields beside a text or a record that don't change how it is read.
OPTIONAL = ("id", "name", "source", "lang", "language", "model", "created", "timestamp", "score", "weight", "category", "title", "metadata", "tool_call_id", "type")


def shape(record: Column) -> Column:
    """The nested field paths of a variant in one string: its schema without the kinds of leaves and without OPTIONAL fields.

    A list of parts as a text counts as a leaf, and so does a list without items.
    """
    bare = F.regexp_replace(F.schema_of_variant(record), r"(?<=: |ARRAY<)(?!OBJECT|ARRAY)[A-Z]+(\(\d+(,\d+)?\))?", "_")
    bare = F.regexp_replace(bare, r"\s", "")
    bare = F.regexp_replace(bare, rf"(?<=[<,])(?:{'|'.join(OPTIONAL)}):(?:_|OBJECT<[^<>]*>|ARRAY<_>),?", "")
    bare = F.regexp_replace(bare, r",(?=>)", "")
    return F.regexp_replace(bare, r"(?<=\b(?:content|text|value):)ARRAY<(?:OBJECT<(?:[^<>]*)>|_)>", "_")


def text_of(record: Column, path: str) -> Column:
    """The text at a path: a string, or the texts of a list of parts joined; empty for null."""
    parts = F.try_variant_get(record, path, "array<variant>")
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(~F.startswith(F.schema_of_variant(p), F.lit("OBJECT")), F.try_variant_get(p, "$", "string")), F.lit(""))
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(F.coalesce(F.try_variant_get(record, path, "string"), F.lit("")))


def record_fingerprint(record: Column) -> Column:
    return F.sha2(shape(record), 256)


@dataclass(frozen=True)
class Mapping:
    """Where one layout keeps its turns.

    fields: the record's fields, by whose shape it is known: "messages[]:content,role" or "instruction,output".
    messages: path of a list, with the names of its role and text fields; or turns: (role, path) in order.
    roles: names used by the layout for the canonical roles. spare: paths whose turn is left out where the text is empty.
    """

    fields: str
    messages: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    spare: tuple[str, ...] = ()

    @property
    def shape(self) -> str:
        """As ``shape`` gives it for a record with these fields."""
        parts = []
        for part in sorted(self.fields.split(" ")):
            name, _, inner = part.partition("[]:")
            # a name with [] and no fields stands for a list without items
            parts.append(f"{name}:ARRAY<OBJECT<{','.join(f'{x}:_' for x in sorted(inner.split(',')))}>>" if inner else f"{name[:-2]}:ARRAY<_>" if name.endswith("[]") else f"{name}:_")
        return f"OBJECT<{','.join(parts)}>"

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.shape.encode()).hexdigest()

    def read(self, record: Column) -> Column:
        if self.messages:
            path, role, text = self.messages
            items = F.try_variant_get(record, f"$.{path}", "array<variant>")
            names = F.create_map(*[F.lit(x) for pair in self.roles.items() for x in pair]) if self.roles else None
            own = lambda m: F.coalesce(F.try_variant_get(m, f"$.{role}", "string"), F.lit(""))
            known = (lambda m: F.coalesce(F.element_at(names, own(m)), own(m))) if names is not None else own
            return F.transform(items, lambda m: F.struct(known(m).alias("role"), text_of(m, f"$.{text}").alias("text")))
        turn = lambda role, path: F.struct(F.lit(role).alias("role"), text_of(record, f"$.{path}").alias("text"))
        found = F.array(*[F.when(text_of(record, f"$.{path}") != "", turn(role, path)) if path in self.spare else turn(role, path) for role, path in self.turns])
        return F.array_compact(found)


#: Layouts that are known without further configuration.
MAPPINGS = (
    Mapping("messages[]:content,role", messages=("messages", "role", "content")),
    Mapping("turns[]:role,text,turn", messages=("turns", "role", "text")),
    Mapping("turns[]:role,text", messages=("turns", "role", "text")),
    Mapping("conversations[]:from,value", messages=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("completion prompt", turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt response", turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction output", turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("input instruction output", turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")), spare=("input",)),
    Mapping("prompt response system", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), spare=("system",)),
    *[Mapping(x, messages=(x[:-2], "role", "content")) for x in ("messages[]", "turns[]", "conversations[]")],
    Mapping("answer question", turns=(("user", "question"), ("assistant", "answer"))),
)


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with a variant column: adds fingerprint and turns (null where no mapping has the fingerprint)."""
    found = F.lit(None).cast(_TURN)
    for m in mappings:
        found = F.when(F.col("fingerprint") == m.fingerprint, m.read(F.col(record))).otherwise(found)
    return records.withColumn("fingerprint", record_fingerprint(F.col(record))).withColumn("turns", found)


def unknown_layouts(records: DataFrame, record: str = "record") -> DataFrame:
    """(fingerprint, shape, n) of canonical_turns' rows that no mapping reads."""
    return records.where("turns is null").groupBy("fingerprint", shape(F.col(record)).alias("shape")).agg(F.count("*").alias("n"))


#: Schemas of tables with a row for each turn, by the hash of their paths: the columns of conversation, order, role and text.
ROW_LAYOUTS = {
    fingerprint(["conv_id", "turn", "role", "text"]): ("conv_id", "turn", "role", "text"),
    fingerprint(["conversation_id", "turn_index", "role", "content"]): ("conversation_id", "turn_index", "role", "content"),
    fingerprint(["conv_id", "turn", "from", "value"]): ("conv_id", "turn", "from", "value"),
}


def turns_of_rows(rows: DataFrame, columns: tuple[str, str, str, str] | None = None) -> DataFrame:
    """(conv_id, turns) from a table with a row for each turn, by its schema's fingerprint or by naming its columns."""
    found = columns or ROW_LAYOUTS.get(fingerprint(field_paths(rows.schema)))
    if found is None:
        raise ValueError(f"no layout for the fields {field_paths(rows.schema)}")
    conv, turn, role, text = found
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    packed = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")))).alias("sorted"))
    return packed.select("conv_id", F.transform("sorted", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from a table with a row for each turn: one variant a conversation, in the layout that ``turns[]:role,text`` reads."""
    turns = turns_of_rows(rows)
    return turns.select("conv_id", F.to_variant_object(F.struct("turns")).alias("record"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turns): adds the text and loss_mask, an array of (start, length) in code points, from 0."""
    marked = lambda t: F.concat(F.lit(START + OPEN), escaped(t["role"]), F.lit(CLOSE), escaped(t["text"]), F.lit(END))
    out = conversations.withColumn("parts", F.transform("turns", lambda t: F.struct(F.length(marked(t)).alias("n"), F.length(escaped(t["text"])).alias("own"), (t["role"] == "assistant").alias("loss"))))
    out = out.withColumn("text", F.array_join(F.transform("turns", marked), ""))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["n"]).alias("at"),
        F.when(p["loss"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + p["n"] - len(END) - p["own"]).alias("start"), p["own"].alias("length"))))).otherwise(acc["mask"]).alias("mask"),
    )
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("mask"))
    return out.withColumn("loss_mask", F.aggregate("parts", nothing, step, lambda acc: acc["mask"])).drop("parts")


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(text, F.lit(r"\Q" + END + r"\E")), lambda x: x != "")
    at = lambda x: F.locate(CLOSE, x)
    begin = len(START + OPEN) + 1
    return F.transform(parts, lambda x: F.struct(unescaped(F.substring(x, F.lit(begin), F.instr(x, CLOSE) - begin)).alias("role"), unescaped(F.substring(x, F.instr(x, CLOSE) + len(CLOSE), F.length(x))).alias("text")))


def loss_texts(text: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    return F.transform(mask, lambda m: unescaped(F.substring(text, m["start"] + 1, m["length"])))
