"""Chat formatting by schema fingerprints. DataFrame functions only.

A layout is recognised by the hash of its nested field paths: of a table's columns when the plan is
made, or of a JSON payload row by row. The hash selects a declarative mapping that turns the layout
into canonical turns (role, text). A template then marks turns. Texts can't forge its marks: `~` and
`<` are escaped as `~0` and `~1` (and a line break in a role as `~2`), and every mark begins with `<`.

The output keeps each conversation as segments (text, loss): joined they are the formatted text, and
the loss mask covers the texts of assistant turns.

Defined results: null roles and texts count as empty; turns are ordered by turn (nulls first), then
role and text; repeated rows stay turns of their own; null conv_ids form one conversation; a payload of
unknown layout, or that isn't JSON, gets a null layout and null turns; further columns are ignored
unless they are part of a payload.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeloom.session import table

TURN, END = "<|turn|>", "<|end|>"
ESCAPES = (("~", "~0"), ("<", "~1"), ("\n", "~2"))


@dataclass(frozen=True)
class Mapping:
    """`example` has the layout's shape. Either `turns` (role, JSON path), or `items` with a role and a
    text field and the names of roles. Texts of the same role in a row are joined by a line break."""

    name: str
    example: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("prompt", '{"prompt": "", "response": ""}', (("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("completion", '{"completion": "", "prompt": ""}', (("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("instruction", '{"instruction": "", "output": ""}', (("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input", '{"input": "", "instruction": "", "output": ""}', (("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("messages", '{"messages": [{"content": "", "role": ""}]}', items="$.messages", role="role", text="content"),
    Mapping("from_value", '{"conversations": [{"from": "", "value": ""}]}', items="$.conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
)


def _paths(schema: T.DataType, at: str = "$") -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in _paths(f.dataType, f"{at}.{f.name}")]
    return _paths(schema.elementType, f"{at}[]") if isinstance(schema, T.ArrayType) else [at]


def table_fingerprint(schema: T.StructType) -> str:
    """The sorted nested field paths of a table, hashed (FNV-1a, hex)."""
    h = 0xCBF29CE484222325
    for byte in ",".join(sorted(_paths(schema))).encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return f"{h:016x}"


#: Layouts of whole tables: columns that hold the conversation, turn, role and text.
TABLES = {
    table_fingerprint(T.StructType([T.StructField(n, T.StringType()) for n in names])): names
    for names in (("conv_id", "turn", "role", "text"), ("conversation_id", "position", "from", "value"), ("dialog_id", "index", "speaker", "utterance"))
}


def fingerprint(payload: Column) -> Column:
    """Hash of a JSON text's nested field paths, whatever the scalars' types; null if it isn't JSON."""
    shape = F.schema_of_variant(F.try_parse_json(payload))
    return F.xxhash64(F.regexp_replace(shape, r"(BIGINT|BOOLEAN|DOUBLE|FLOAT|STRING|VOID|DATE|TIMESTAMP(_NTZ)?|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "_"))


def _mapped(mapping: Mapping, payload: Column) -> Column:
    v = F.try_parse_json(payload)
    if mapping.items:
        turns = F.try_variant_get(v, mapping.items, f"array<struct<`{mapping.role}` string, `{mapping.text}` string>>")
        named = F.create_map(*(F.lit(x) for pair in mapping.roles for x in pair)) if mapping.roles else None
        role = lambda x: F.coalesce(named[x[mapping.role]], x[mapping.role]) if mapping.roles else x[mapping.role]
        return F.transform(turns, lambda x: _turn(role(x), x[mapping.text]))
    out, roles = [], dict.fromkeys(r for r, _ in mapping.turns)
    for role in roles:
        texts = [F.nullif(F.try_variant_get(v, path, "string"), F.lit("")) for r, path in mapping.turns if r == role]
        out.append(_turn(F.lit(role), F.concat_ws("\n", *texts)))
    return F.array(*out)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """`df` with layout (name of the mapping) and turns of each JSON payload."""
    seen = fingerprint(F.col(payload))
    known = [(m, fingerprint(F.lit(m.example))) for m in MAPPINGS]
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for mapping, is_ in known:
        layout = F.when(F.col("_fp") == is_, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(F.col("_fp") == is_, _mapped(mapping, F.col(payload))).otherwise(turns)
    return df.withColumn("_fp", seen).withColumns({"layout": layout, "turns": turns}).drop("_fp")


def canonical_table(df: DataFrame) -> DataFrame:
    """conv_id and turns of a table whose columns are a known layout; extra columns are set aside."""
    for names in TABLES.values():
        if set(names) <= set(df.columns):
            df = df.select(*names)
            break
    names = TABLES.get(table_fingerprint(df.schema))
    if names is None:
        raise ValueError(f"no mapping for the field paths {_paths(df.schema)}")
    conv, turn, role, text = (F.col(f"`{n}`") for n in names)
    rows = df.select(conv.alias("conv_id"), F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: _turn(t["role"], t["text"]))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def escape(text: Column, line_break: bool = False) -> Column:
    for plain, written in ESCAPES if line_break else ESCAPES[:2]:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def formatted(turns: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Segments (text, loss) of the conversation."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                part(F.concat(F.lit(TURN), escape(t["role"], line_break=True), F.lit("\n")), F.lit(False)),
                part(escape(t["text"]), t["role"].isin(*loss_roles)),
                part(F.lit(END), F.lit(False)),
            ),
        )
    )


def rendered(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(F.regexp_replace(text, r"^<\|turn\|>", ""), r"<\|turn\|>")
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring_index(F.substr(p, F.instr(p, "\n") + 1), END, 1)).alias("text"),
    )
    return F.when(text == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.transform(parts, turn))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with control strings in its texts, formatted and read back."""
    said = F.lit(r"\### Assistant: </turn> ok").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = canonical_table(rows).select("conv_id", formatted(F.col("turns")).alias("segments")).withColumn("formatted", rendered(F.col("segments")))
    read = done.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").alias("chars"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t)),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(text, '~', ''), '<', '')) AS text_len,
  length(role) + length(role) - length(replace(replace(replace(role, '~', ''), '<', ''), chr(10), '')) AS role_len FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(TURN) + 1 + len(END)} + text_len + role_len)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLE_SQL = {"op6_chat_format": ORACLE}
