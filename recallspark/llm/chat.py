"""Chat formatting: schema fingerprints select declarative mappings into canonical turns (DataFrame functions only).

A record is a JSON object of any layout, held as a variant. Its fingerprint is the hash of its
nested field paths, as the engine's schema_of_variant gives them, without the leaf types. A
Mapping says, in field paths alone, where the turns of one layout are; the fingerprints it
serves are those of its field paths with any of its optional ones, and of an empty list.

Template: <|im_start|>ROLE\\nTEXT<|im_end|>\\n for each turn. In texts and roles every "<" that is
followed by any number of backslashes and "|" gets one backslash more, so no text can hold a
control string; taking one away restores it. In roles, backslash and newline are written \\\\ and \\n.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. shape: the layout's field paths in order, parts joined by '.', [] for an array.

    Either list_path names an array and role_field and text_field fields of its items, or turns
    gives (role, path) pairs, in order; turns whose path is null or missing are left out if
    optional. roles maps the layout's role names to canonical ones; others stay. extra: field paths that may be there and are not
    read. parts_field: the text field is a list of objects, whose fields of that name are joined.
    """

    name: str
    shape: tuple[str, ...]
    list_path: str = ""
    role_field: str = ""
    text_field: str = ""
    turns: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    extra: tuple[str, ...] = ()
    parts_field: str = ""

    def shapes(self) -> list[tuple[str, ...]]:
        some = [self.shape, *([tuple(p for p in self.shape if "[]" not in p) + (f"{self.list_path[2:]}[]",)] if self.list_path else [])]
        items = [tuple(x) for n in range(len(self.extra) + 1) for x in combinations(self.extra, n)]
        return [s + x for s in some for x in items if s is self.shape or not any("[]" in p for p in x)]


MAPPINGS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), "$.messages", "role", "content", extra=("id", "source", "messages[].name", "messages[].weight")),
    Mapping("message_parts", ("messages", "messages[].content", "messages[].content[].text", "messages[].content[].type", "messages[].role"), "$.messages", "role", "content", extra=("id", "source", "messages[].name"), parts_field="text"),
    Mapping("sharegpt", ("conversations", "conversations[].from", "conversations[].value"), "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant")), extra=("id", "source", "conversations[].weight")),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), turns=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")), optional=("$.input",)),
    Mapping("system_prompt", ("prompt", "response", "system"), turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")), optional=("$.system",)),
    Mapping("nested_chosen", ("chosen", "chosen.content", "chosen.role", "prompt"), turns=(("user", "$.prompt"), ("assistant", "$.chosen.content"))),
)


def field_paths(schema: Column) -> Column:
    """The schema text of a variant with its leaf types removed: its nested field names and arrays."""
    bare = F.regexp_replace(schema, r": (?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+,\d+\)|FLOAT|BINARY)", "")
    return F.regexp_replace(bare, r"ARRAY<VOID>", "ARRAY<OBJECT<>>")


def fingerprint(record: Column) -> Column:
    """sha-256 of the nested field paths of a variant; null for null."""
    return F.sha2(field_paths(F.schema_of_variant(record)), 256)


def shape_text(shape: tuple[str, ...]) -> str:
    """The field-path text that records of a shape have: names in order, nesting as OBJECT and ARRAY."""

    def render(prefix: str) -> str:
        names = sorted({p[len(prefix) :].split(".")[0].split("[")[0] for p in shape if p.startswith(prefix) and p != prefix})
        parts = []
        for n in names:
            full = prefix + n
            if full + "[]" in shape:
                parts.append(f"{n}: ARRAY<OBJECT<>>")
            elif any(p.startswith(full + "[].") for p in shape):
                parts.append(f"{n}: ARRAY<OBJECT<{render(full + '[].')}>>")
            elif any(p.startswith(full + ".") for p in shape):
                parts.append(f"{n}: OBJECT<{render(full + '.')}>")
            else:
                parts.append(n)
        return ", ".join(parts)

    return f"OBJECT<{render('')}>"


def _roles(m: Mapping, role: Column) -> Column:
    out = role
    for theirs, ours in m.roles:
        out = F.when(role == theirs, F.lit(ours)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _turns(m: Mapping, record: Column) -> Column:
    if m.list_path:
        if m.parts_field:
            items = F.try_variant_get(record, m.list_path, f"array<struct<{m.role_field}: string, {m.text_field}: array<struct<{m.parts_field}: string>>>>")
            joined = lambda t: F.array_join(F.transform(t[m.text_field], lambda p: p[m.parts_field]), "")
            return F.transform(items, lambda t: F.struct(_roles(m, t[m.role_field]).alias("role"), F.coalesce(joined(t), F.lit("")).alias("text")))
        items = F.try_variant_get(record, m.list_path, f"array<struct<{m.role_field}: string, {m.text_field}: string>>")
        return F.transform(items, lambda t: F.struct(_roles(m, t[m.role_field]).alias("role"), F.coalesce(t[m.text_field], F.lit("")).alias("text")))
    made = []
    for role, path in m.turns:
        text = F.try_variant_get(record, path, "string")
        turn = F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        made.append(F.when(text.isNull() | (text == ""), None).otherwise(turn) if path in m.optional else turn)
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical_turns(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with fingerprint, layout (the mapping's name, or null) and turns array<struct<role, text>>.

    The mapping table is a constant of the plan. Records that no mapping knows get null turns;
    nothing is guessed from field names.
    """
    record = F.col(column)
    out = records.withColumn("fingerprint", fingerprint(record))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for m in reversed(mappings):  # the first that knows a shape has it
        hit = F.col("fingerprint").isin(*[hashlib.sha256(shape_text(x).encode()).hexdigest() for x in m.shapes()])
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, _turns(m, record)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def format_turns(turns: Column) -> Column:
    """struct(formatted, loss): the text and the spans under the loss mask, in code points, end exclusive.

    A span covers the escaped text of one assistant turn, without its marks.
    """
    pieces = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))

    def spans(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["at"] + F.length(t["head"])
            end = begin + F.length(t["body"])
            span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
            return F.struct((end + len(END) + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(p, start, step)["spans"]

    return let(pieces, lambda p: F.struct(F.array_join(F.transform(p, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"), spans(p).alias("loss")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: format_turns undone."""
    chunks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda c: c != "")

    def turn(c: Column) -> Column:
        rest = F.substring(c, F.lit(len(START) + 1), F.length(c))
        role = F.substring_index(rest, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(rest, F.length(role) + 2, F.length(rest))).alias("text"))

    return F.transform(chunks, turn)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def format_chats(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with fingerprint, layout, turns, formatted text and loss spans; columns of these names are replaced, others stay. Null records and unknown
    layouts: null in layout, turns, formatted and loss. A record without turns: an empty text. Every row by itself; an empty table gives an empty result.
    """
    turned = canonical_turns(records, column, mappings)
    return turned.withColumn("formatted", format_turns(F.col("turns"))).withColumn("loss", F.col("formatted.loss")).withColumn("formatted", F.col("formatted.formatted"))


def conversation_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): one {"messages": [...]} record for each conversation, rows by turn.

    Null text: empty; null role: empty. Rows of one turn, repeated ones too: by role, then text. A null conv_id is one conversation. A conversation is one
    value of the output, so its rows meet in one task by definition; one beyond the engine's bound of a variant has a null record.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["content"].alias("content"), r["role"].alias("role")))
    return grouped.select("conv_id", F.try_parse_json(F.to_json(F.struct(messages.alias("messages")))).alias("record"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What op3 returns, read back from formatted and loss."""
    out = formatted.select("conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("read"), F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("learnt"))
    joined = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) AS text_n FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + text_n + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
