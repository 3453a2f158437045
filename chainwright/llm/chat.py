"""Chat formatting: the hash of the nested field paths of a record selects a declarative mapping to canonical turns.

A record is a struct whose filled fields differ from row to row. The paths of its filled fields are hashed; a mapping
is found by the hash of the paths it declares, and says where roles and texts are. Canonical turns are written in a
template whose control strings cannot occur in a text or role, because both are escaped reversibly. All of it is
column expressions; only the turns of one conversation are brought together, once.

Odd input: a null text or role is empty; a conversation's rows of equal turn number are ordered by role and text, nulls
first; a repeated row is a repeated turn; rows without a conversation id form one conversation; a record whose paths
match no mapping keeps its row with a null layout and null turns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.common import attach, hex_digest, release, starts

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"


@dataclass(frozen=True)
class Mapping:
    """A layout: ``turns`` (array of structs) with ``role`` and ``text`` fields, or ``parts`` as (role, field) in order.

    Fields named in ``joined`` are one text, separated by an empty line.
    """

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.turns:
            return sorted([f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"])
        return sorted({f for _, f in self.parts} | set(self.joined))

    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(self.paths()).encode()).hexdigest()


SHARE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("rows", turns="turns", role="role", text="text"),
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("share", turns="conversations", role="from", text="value", roles=SHARE),
    Mapping("instruction", parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", parts=(("user", "instruction"), ("assistant", "output")), joined=("instruction", "input")),
    Mapping("prompt_completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", parts=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(record: Column, kind: T.StructType, known: set[str]) -> Column:
    """Hash of the sorted paths of the fields that are filled in the record; paths that no mapping names do not count."""
    present = []
    for f in kind.fields:
        paths = sorted(set(field_paths(f.dataType, f.name)) & known)
        if paths:
            present.append(F.when(record.getField(f.name).isNotNull(), F.array(*[F.lit(p) for p in paths])))
    if not present:
        return hex_digest(F.lit(""))
    return hex_digest(F.array_join(F.array_sort(F.flatten(F.filter(F.array(*present), lambda x: x.isNotNull()))), "\n"))


def _turns(record: Column, m: Mapping) -> Column:
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.turns:
        named = F.create_map(*[F.lit(x) for pair in m.roles.items() for x in pair]) if m.roles else None
        role = lambda t: empty(t[m.role]) if named is None else F.coalesce(named[t[m.role]], empty(t[m.role]))
        return F.transform(record.getField(m.turns), lambda t: F.struct(role(t).alias("role"), empty(t[m.text]).alias("text")))
    text = lambda f: F.array_join(F.filter(F.array(*[empty(record.getField(x)) for x in m.joined]), lambda x: x != ""), "\n\n") if f in m.joined else empty(record.getField(f))
    return F.array(*[F.struct(F.lit(role).alias("role"), text(f).alias("text")) for role, f in m.parts])


def canonical_turns(df: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` (array of role and text) to rows with a struct ``record``."""
    kind = df.schema[record].dataType
    there = set(field_paths(kind))
    usable = [m for m in mappings if set(m.paths()) <= there]
    work = attach(df, [record]).withColumn("_print", fingerprint(F.col("_0"), kind, {p for m in mappings for p in m.paths()}))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    layout = F.lit(None).cast("string")
    for m in usable:
        chosen = F.col("_print") == m.fingerprint()
        turns = F.when(chosen, _turns(F.col("_0"), m)).otherwise(turns)
        layout = F.when(chosen, F.lit(m.name)).otherwise(layout)
    return release(work, {"fingerprint": F.col("_print"), "layout": layout, "turns": turns})


def parse_records(df: DataFrame, raw: str, schema: T.StructType | str, out: str = "record") -> DataFrame:
    """JSON texts as structs of one schema that holds all layouts; fields a text lacks are null."""
    return df.withColumn(out, F.from_json(F.col(raw), schema))


def escape(text: Column) -> Column:
    """Double every backslash, then part ``<`` and ``|`` by one: no control string is left, and the way back is unique."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns", learned: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: code points (start, end) of the texts of the role to learn from."""
    work = attach(df, [turns])
    work = work.withColumn(
        "_heads", F.transform("_0", lambda t: F.concat(F.lit(TURN), escape(F.coalesce(t["role"], F.lit(""))), F.lit(BODY)))
    ).withColumn("_texts", F.transform("_0", lambda t: escape(F.coalesce(t["text"], F.lit("")))))
    work = work.withColumn(
        "_lengths", F.transform("_heads", lambda h, i: (F.char_length(h) + F.char_length(F.get("_texts", i)) + len(END)).cast("long"))
    )
    work = starts(work, "_lengths", "_from")
    span = lambda t, i: F.struct(
        (F.get("_from", i) + F.char_length(F.get("_heads", i))).alias("start"),
        (F.get("_from", i) + F.char_length(F.get("_heads", i)) + F.char_length(F.get("_texts", i))).alias("end"),
        (t["role"] == learned).alias("learned"),
    )
    spans = F.filter(F.transform("_0", span), lambda s: s["learned"])
    return release(
        work,
        {
            "formatted": F.array_join(F.transform("_heads", lambda h, i: F.concat(h, F.get("_texts", i), F.lit(END))), ""),
            "loss_spans": F.transform(spans, lambda s: s.dropFields("learned")),
        },
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    bodies = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda b: b != "")
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.substring_index(b, BODY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(b, BODY, -1), END, 1)).alias("text")
        ),
    )


def read_masked(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the spans, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def group_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record per conversation from rows by turn."""
    member = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("_turns")).select(key, F.struct(F.col("_turns").alias("turns")).alias("record"))


CONTROL = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark, folder: str) -> DataFrame:
    """Format every conversation and one that is made of control strings, and read it back."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    done = format_turns(canonical_turns(group_turns(rows.unionByName(more)))).select("conv_id", "formatted", "loss_spans")
    back = done.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", read_masked(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        hex_digest(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("_loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = f"""
WITH r AS (
  SELECT conv_id, turn, role AS ro, text AS te FROM conversations
  UNION ALL SELECT -7, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '{CONTROL}' FROM range(2) AS u(t)),
c AS (SELECT *, coalesce(ro, '') AS role, coalesce(te, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, ro NULLS FIRST, te NULLS FIRST) AS k FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN + BODY + END)} + length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
    + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
