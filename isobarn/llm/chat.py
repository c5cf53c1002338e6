"""Chat formatting by schema fingerprinting (operator 8), in DataFrame operations only.

The hash of a table's nested field paths selects a declarative mapping into canonical turns, which one template then
writes out. The template's marks, and the marks of other common templates, are escaped inside roles and texts in a way
that can be undone; the loss mask covers the assistants' texts alone, and everything can be read back from the output.

Defined results: null roles and texts are empty; turns are ordered by turn number (nulls first), then role and text,
and repeated turns stay; a null conversation id is one conversation; other columns, whatever their names, are ignored
by the hash; an unknown layout is an error that names its paths; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Strings that stand for structure in this or another template; their first characters are escaped in texts.
CONTROL = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
CODES = {"<": "%3C", "[": "%5B"}
ROLE_CODES = {"|": "%7C", "\n": "%0A"}
#: What other layouts call the roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths, with [] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _names(role: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLE_NAMES.items())
    return f"CASE lower({role}) {cases} ELSE {role} END"


def _pair(user: str, assistant: str) -> str:
    return f"array(struct('user' AS role, {user} AS text), struct('assistant' AS role, {assistant} AS text))"


_TASK = "if(coalesce(input, '') = '', instruction, concat(coalesce(instruction, ''), '\\n\\n', input))"
#: Layouts: their paths, the id, and the turns as SQL; `rows` is for one turn a row.
LAYOUTS = [
    {"paths": {"conv_id", "turn", "role", "text"}, "id": "conv_id", "rows": True},
    {"paths": {"conv_id", "messages[].role", "messages[].content"}, "id": "conv_id", "turns": f"transform(messages, m -> struct({_names('m.role')} AS role, m.content AS text))"},
    {"paths": {"id", "conversations[].from", "conversations[].value"}, "id": "id", "turns": f"transform(conversations, m -> struct({_names('m.from')} AS role, m.value AS text))"},
    {"paths": {"id", "instruction", "input", "output"}, "id": "id", "turns": _pair(_TASK, "output")},
    {"paths": {"id", "instruction", "output"}, "id": "id", "turns": _pair("instruction", "output")},
    {"paths": {"id", "prompt", "completion"}, "id": "id", "turns": _pair("prompt", "completion")},
    {"paths": {"id", "prompt", "response"}, "id": "id", "turns": _pair("prompt", "response")},
    {"paths": {"id", "system", "prompt", "response"}, "id": "id", "turns": "concat(array(struct('system' AS role, system AS text)), " + _pair("prompt", "response") + ")"},
]
MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}
MAPPINGS_PATHS = [x["paths"] for x in LAYOUTS]


#: Paths that any layout knows; others don't count for the fingerprint.
KNOWN = set().union(*MAPPINGS_PATHS)


def layout(table: DataFrame) -> dict:
    """The mapping that the hash of the table's known paths selects.

    Where no mapping has that hash, since further columns bear names that other layouts know, the largest layout that the
    table holds whole is taken.
    """
    own = set(paths(table.schema))
    if found := MAPPINGS.get(fingerprint(own & KNOWN)):
        return found
    held = [x for x in LAYOUTS if x["paths"] <= own]
    if not held:
        raise ValueError(f"no mapping for a table with the paths {sorted(own)}")
    return max(held, key=lambda x: len(x["paths"]))


def canonical(table: DataFrame) -> DataFrame:
    """conv_id and turns (role, text) of every conversation."""
    own = layout(table)
    if own.get("rows"):
        one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        grouped = table.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
        return grouped.select("conv_id", F.expr(f"cast(transform(all, t -> struct(t.role AS role, t.text AS text)) AS {TURNS})").alias("turns"))
    turns = f"transform({own['turns']}, t -> struct(coalesce(t.role, '') AS role, coalesce(t.text, '') AS text))"
    return table.select(F.col(own["id"]).alias("conv_id"), F.expr(f"cast({turns} AS {TURNS})").alias("turns"))


#: Types of the top fields that layouts know, for records that come as JSON.
_FIELDS = {"messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>"}


def canonical_records(records: DataFrame, column: str = "record") -> DataFrame:
    """conv_id (as string), turns and layout of JSON records of mixed layouts, each mapped by its own fingerprint.

    A record's fingerprint is the hash of the nested paths of its known fields, computed for each row; it selects one of
    the mappings of whole conversations. conv_id is null and turns are empty, and layout is null, where none fits. Turns as
    rows have no place in a record.
    """
    whole = [x for x in LAYOUTS if not x.get("rows")]
    tops = sorted({p.split(".")[0].removesuffix("[]") for x in whole for p in x["paths"]})
    shape = lambda t: f"regexp_replace(schema_of_variant(variant_get(v, '$.{t}')), ': (?!ARRAY|OBJECT)[A-Z]+([(][0-9,]*[)])?', '')"

    def told(x: dict) -> str:
        """The same shape, from the paths of a layout."""
        inner: dict[str, list[str]] = {}
        for p in x["paths"]:
            top, _, rest = p.partition(".")
            inner.setdefault(top.removesuffix("[]"), []).extend([rest] if rest else [])
        return ";".join(f"{t}=" + (f"ARRAY<OBJECT<{', '.join(sorted(inner[t]))}>>" if inner[t] else "") for t in sorted(inner))

    parts = ", ".join(f"if(variant_get(v, '$.{t}') IS NULL, NULL, concat('{t}=', {shape(t) if t in _FIELDS else repr('')}))" for t in tops)
    code = F.expr(f"sha2(array_join(array_compact(array({parts})), ';'), 256)")
    fields = [F.expr(f"try_variant_get(v, '$.{t}', '{_FIELDS.get(t, 'string')}')").alias(t) for t in tops]
    rows = records.select(F.expr(f"try_parse_json(`{column}`)").alias("v")).select(code.alias("code"), *fields)
    turns, conv, name = F.expr(f"cast(array() AS {TURNS})"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, x in enumerate(whole):
        same = F.col("code") == hashlib.sha256(told(x).encode()).hexdigest()
        turns = F.when(same, F.expr(f"cast(transform({x['turns']}, t -> struct(coalesce(t.role, '') AS role, coalesce(t.text, '') AS text)) AS {TURNS})")).otherwise(turns)
        conv, name = F.when(same, F.col(x["id"])).otherwise(conv), F.when(same, F.lit(i)).otherwise(name)
    return rows.select(conv.alias("conv_id"), turns.alias("turns"), name.alias("layout"))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(CODES[mark[0]] + mark[1:]))
    for plain, code in ROLE_CODES.items() if role else ():
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def restore(text: Column, role: bool = False) -> Column:
    out = text
    for plain, code in {**CODES, **(ROLE_CODES if role else {})}.items():
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: the (start, stop) of the assistants' escaped texts, in code points."""

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(CLOSE))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("counts"))

    pieces = conversations.select("conv_id", F.transform("turns", piece).alias("pieces"))
    whole = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    walk = (
        "aggregate(pieces, named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,stop:int>>)), (a, p) -> named_struct("
        f"'at', a.at + char_length(p.head) + char_length(p.body) + {len(END)}, 'out', if(p.counts, array_append(a.out, "
        "named_struct('start', a.at + char_length(p.head), 'stop', a.at + char_length(p.head) + char_length(p.body))), a.out)), a -> a.out)"
    )
    return pieces.select("conv_id", whole.alias("formatted"), F.expr(walk).alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, turns and loss_text, from the formatted text and the loss mask alone."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.instr(p, CLOSE)
        role = F.substr(p, F.lit(len(OPEN) + 1), head - F.lit(len(OPEN) + 1))
        return F.struct(restore(role, role=True).alias("role"), restore(F.substr(p, head + F.lit(len(CLOSE)))).alias("text"))

    masked = F.transform("loss", lambda s: restore(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return output.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), F.concat_ws("", masked).alias("loss_text"))
