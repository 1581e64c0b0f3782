r"""Chat formatting by schema fingerprints.

A record is a JSON text of any known layout. Its nested field paths (names only, types erased) are hashed; the
hash selects a declarative mapping, an SQL expression that turns this layout into canonical turns (role, text).
A template then renders turns as

    ### role: text</turn>\n

with control strings inside role and text escaped: backslash -> \\, `###` -> \h, `</turn>` -> \e, and in roles also
`:` -> \c and a line end -> \n. The loss mask lists the character spans of assistant texts. `parse` reads turns and
masked texts back from the rendered text alone and its spans.

Cases: null texts and roles are empty; rows of one turn number are ordered by role, then text; repeated rows are
turns of their own; conversations whose record has more than LONG characters take their turns from the columns, and
records of a table of their own (`canonical_turns`) that are too long to parse raise an error; a null conversation id is a conversation; a record of unknown layout has no turns; an empty
table gives an empty result; columns beyond conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a record up to which it is parsed: JSON strings beyond 20,000,000 characters and variants beyond 128 MiB are refused.
LONG = 19_000_000
TURNS = "array<struct<role: string, text: string>>"
_END, _HEAD = "</turn>", "###"

#: Layouts by name: a record that shows the layout's field paths, and the expression over variant `v` that maps it.
LAYOUTS: dict[str, tuple[dict, str]] = {
    "messages": (
        {"messages": [{"role": "", "content": ""}]},
        "transform(variant_get(v, '$.messages', 'array<struct<role: string, content: string>>'), m -> named_struct('role', m.role, 'text', m.content))",
    ),
    "conversations": (
        {"conversations": [{"from": "", "value": ""}]},
        "transform(variant_get(v, '$.conversations', 'array<struct<from: string, value: string>>'), m -> named_struct('role', "
        "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))",
    ),
    "prompt": (
        {"prompt": "", "response": ""},
        "array(named_struct('role', 'user', 'text', variant_get(v, '$.prompt', 'string')), named_struct('role', 'assistant', 'text', variant_get(v, '$.response', 'string')))",
    ),
    "instruction": (
        {"instruction": "", "input": "", "output": ""},
        "array(named_struct('role', 'user', 'text', concat(variant_get(v, '$.instruction', 'string'), "
        "if(coalesce(variant_get(v, '$.input', 'string'), '') = '', '', concat('\\n\\n', variant_get(v, '$.input', 'string'))))), "
        "named_struct('role', 'assistant', 'text', variant_get(v, '$.output', 'string')))",
    ),
}


def fingerprint(variant: Column) -> Column:
    """Hash of a record's nested field paths; scalar types, which vary with values, are erased."""
    paths = F.regexp_replace(F.schema_of_variant(variant), r"\b(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\([0-9,]*\)|VARIANT)\b", "")
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Replaces the JSON text `column` by `turns`, chosen by the record's fingerprint; unknown layouts give none."""
    v = records.withColumn("v", F.try_parse_json(F.col(column))).withColumn("_print", fingerprint(F.col("v")))
    out = None
    for example, mapping in LAYOUTS.values():
        mine = F.col("_print") == fingerprint(F.parse_json(F.lit(json.dumps(example))))
        turns = F.expr(mapping).cast(TURNS)
        out = F.when(mine, turns) if out is None else out.when(mine, turns)
    turns = F.coalesce(out, F.array().cast(TURNS))
    long = F.col("v").isNull() & (F.length(column) > LONG)
    turns = F.when(long, F.raise_error(F.lit("a record is too long to be parsed")).cast(TURNS)).otherwise(turns)
    clean = F.transform(turns, lambda x: F.struct(F.coalesce(x.role, F.lit("")).alias("role"), F.coalesce(x.text, F.lit("")).alias("text")))
    return v.withColumn("turns", clean).drop("v", "_print", column)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit(_HEAD), F.lit("\\h")), F.lit(_END), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """Pieces between escaped backslashes hold single-backslash escapes only."""

    def piece(x: Column) -> Column:
        for code, plain in (("\\h", _HEAD), ("\\e", _END), ("\\c", ":"), ("\\n", "\n")):
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def render(df: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_spans`, (start, length) in code points of each assistant text in it."""
    parts = F.transform("turns", lambda x: F.struct(F.concat(F.lit(f"{_HEAD} "), escape_role(x.role), F.lit(": ")).alias("head"), escape(x.text).alias("body"), (x.role == "assistant").alias("loss")))
    df = df.withColumn("_parts", parts)
    df = df.withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p.head, p.body, F.lit(f"{_END}\n"))), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, size: int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin, size = acc["at"] + F.length(p.head), F.length(p.body)
        spans = F.when(p.loss, F.concat(acc.spans, F.array(F.struct(begin.alias("start"), size.alias("size"))))).otherwise(acc.spans)
        return F.struct((begin + size + len(_END) + 1).alias("at"), spans.alias("spans"))

    return df.withColumn("loss_spans", F.aggregate("_parts", start, step, lambda acc: acc.spans)).drop("_parts")


def parse(df: DataFrame) -> DataFrame:
    """Adds `read_turns` (role, text) and `loss_text`, read back from `formatted` and `loss_spans` alone."""
    pieces = F.filter(F.split("formatted", f"{_END}\n"), lambda x: x != "")
    head = r"(?s)^### (.*?): (.*)$"
    turns = F.transform(pieces, lambda x: F.struct(unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s["size"]))), "")
    return df.withColumn("read_turns", turns).withColumn("loss_text", masked)


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record for each conversation: a user and an assistant turn as prompt and response, else messages."""
    return _records(rows).select("conv_id", "record")


def _records(rows: DataFrame) -> DataFrame:
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("m"))
    pair = (F.size("m") == 2) & (F.col("m")[0].role == "user") & (F.get("m", F.lit(1)).role == "assistant")
    as_prompt = F.to_json(F.struct(F.col("m")[0].text.alias("prompt"), F.get("m", F.lit(1)).text.alias("response")))
    as_messages = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("messages")))
    return whole.select("conv_id", "m", F.when(pair, as_prompt).otherwise(as_messages).alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns, formatted, loss_spans of all conversations of a table of turns."""
    records = _records(rows).withColumn("_long", F.length("record") > LONG)
    typed = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    turns = canonical_turns(records.withColumn("record", F.when(~F.col("_long"), F.col("record"))))
    return render(turns.withColumn("turns", F.when(F.col("_long"), typed).otherwise(F.col("turns"))).drop("m", "_long"))
