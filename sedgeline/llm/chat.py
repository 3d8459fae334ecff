"""Chat formatting in DataFrame functions alone: layouts are told apart by a fingerprint of their field paths.

A record is a JSON object. Its nested field paths, as far as any mapping knows
them, are sorted and hashed; the hash selects a declarative mapping from the
layout to canonical turns (role, text). A template then marks turns, escapes
its control strings inside texts reversibly, and gives the spans under the
loss mask.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The layouts. "list" names the array of messages, else each turn is a role and the fields whose texts it joins.
LAYOUTS: dict[str, dict] = {
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "conversations": {"list": "conversations", "role": "from", "text": "value"},
    "turn row": {"role": "role", "text": "text"},
    "prompt and completion": {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt and response": {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    "system, prompt and response": {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "question and answer": {"turns": [("user", ["question"]), ("assistant", ["answer"])]},
    "instruction and output": {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction, input and output": {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
}
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: The template's marks. Every control string is <s>, </s>, or one of these names in brackets, with or without a slash.
MARKS = {"user": "INST", "system": "SYS", "assistant": "OUT"}
OTHER, BODY = "TURN", "BODY"
_CONTROL = r"/?(?:s>|(?:INST|SYS|OUT|TURN|BODY)\])"


def _paths(layout: dict) -> list[str]:
    if "list" in layout:
        return sorted([layout["list"], f"{layout['list']}[].{layout['role']}", f"{layout['list']}[].{layout['text']}"])
    if "turns" in layout:
        return sorted(f for _, fields in layout["turns"] for f in fields)
    return sorted([layout["role"], layout["text"]])


_LISTS = sorted({x["list"] for x in LAYOUTS.values() if "list" in x})
_KNOWN = sorted({p for x in LAYOUTS.values() for p in _paths(x)})
_PRINTS = {name: hashlib.sha256("\n".join(_paths(x)).encode()).hexdigest() for name, x in LAYOUTS.items()}


def _field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def _elements(json: Column, name: str) -> Column:
    return F.from_json(_field(json, name), "array<string>")


def fingerprint(json: Column) -> Column:
    """Hash of the sorted field paths of a record that any mapping knows; null for what is no JSON object."""
    none = F.array().cast("array<string>")

    def below(f: str) -> Column:
        keys = F.transform(F.coalesce(_elements(json, f), none), lambda e: F.coalesce(F.json_object_keys(e), none))
        return F.transform(F.flatten(keys), lambda k: F.concat(F.lit(f"{f}[]."), k))

    nested = [below(f) for f in _LISTS]
    paths = F.array_distinct(F.concat(F.json_object_keys(json), *nested))
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, _KNOWN)))), "\n"), 256)


def _role(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, c), c, F.lit(""))


def _turns(json: Column, layout: dict) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if "list" in layout:
        return F.transform(_elements(json, layout["list"]), lambda e: turn(_role(_field(e, layout["role"])), _field(e, layout["text"])))
    if "turns" not in layout:
        return F.array(turn(_role(_field(json, layout["role"])), _field(json, layout["text"])))
    joined = lambda fields: F.array_join(F.filter(F.array(*(_field(json, f) for f in fields)), lambda x: x != ""), "\n\n")
    every = F.array(*(turn(F.lit(role), joined(fields)) for role, fields in layout["turns"]))
    return F.filter(every, lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical_turns(records: DataFrame, json_col: str = "record", out_col: str = "chat") -> DataFrame:
    """``records`` with the struct ``out_col``: fingerprint, layout, turns (role, text).

    Null texts are empty, null roles too; an instruction's empty input and an
    empty system text of a prompt layout make no turn of their own. A record
    that no mapping fits, or that is no JSON object, keeps its row with a null
    layout and no turns.
    """
    json = F.col(json_col)
    found = records.withColumn("_print", fingerprint(json))
    layout, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for name, of in LAYOUTS.items():
        mine = F.col("_print") == _PRINTS[name]
        layout, turns = F.when(mine, F.lit(name)).otherwise(layout), F.when(mine, _turns(json, of)).otherwise(turns)
    return found.withColumn(out_col, F.struct(F.col("_print").alias("fingerprint"), layout.alias("layout"), F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))).drop("_print")


def escaped(text: Column) -> Column:
    """One backslash more after the first character of each control string, be it escaped already or not."""
    return F.regexp_replace(text, r"([<\[])(\\*)(" + _CONTROL + ")", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(" + _CONTROL + ")", "$1$2$3")


def format_chats(turns: DataFrame, id_col: str = "conv_id", order_cols: tuple[str, ...] = ("turn",), role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss_mask) for each conversation of a table of turns.

    A turn is ``<s>[NAME] text [/NAME]</s>``; a role that has no name of its own
    is written before its text. loss_mask lists the (start, length) of
    assistant texts in code points. Turns of one order value are taken by role
    and text; a null order comes first, a null role or text is empty, and a null
    id is a conversation of its own. Repeated rows are repeated turns.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    marks = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    name = F.coalesce(F.try_element_at(marks, role), F.lit(OTHER))
    head = F.concat(F.lit("<s>["), name, F.lit("] "), F.when(name == OTHER, F.concat(escaped(role), F.lit(f"[{BODY}]"))).otherwise(F.lit("")))
    body = escaped(text)
    rows = turns.select(F.col(id_col), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)), role.alias("_role"), text.alias("_text"), head.alias("_head"), body.alias("_body"), F.concat(F.lit(" [/"), name, F.lit("]</s>")).alias("_tail"))
    keys = [f"_o{i}" for i in range(len(order_cols))]
    by_turn = Window.partitionBy(id_col).orderBy(*keys, "_role", "_text")
    whole = F.length("_head") + F.length("_body") + F.length("_tail")
    rows = rows.select(
        id_col,
        F.row_number().over(by_turn).alias("_at"),
        F.concat("_head", "_body", "_tail").alias("_turn"),
        F.when(F.col("_role") == "assistant", F.struct((F.sum(whole).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - whole + F.length("_head")).cast("long").alias("start"), F.length("_body").cast("long").alias("length"))).alias("_mask"),
    )
    parts = F.array_sort(F.collect_list(F.struct("_at", "_turn", "_mask")))
    out = rows.groupBy(id_col).agg(parts.alias("_parts"))
    return out.select(id_col, F.array_join(F.transform("_parts", lambda p: p["_turn"]), "").alias("formatted"), F.filter(F.transform("_parts", lambda p: p["_mask"]), lambda m: m.isNotNull()).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    names = F.create_map(*(F.lit(x) for k, v in MARKS.items() for x in (v, k)))
    parts = F.filter(F.split(formatted, "</s>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        name = F.regexp_extract(p, r"^<s>\[([A-Z]+)\] ", 1)
        inner = F.substring(p, F.length(name) + F.lit(7), F.length(p) - 2 * F.length(name) - F.lit(10))
        other = F.instr(inner, f"[{BODY}]")
        role = F.when(name == OTHER, unescaped(F.substring(inner, F.lit(1), other - 1))).otherwise(F.try_element_at(names, name))
        text = F.when(name == OTHER, F.substring(inner, other + len(BODY) + 2, F.length(inner))).otherwise(inner)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, turn)


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"].cast("int") + 1, m["length"].cast("int"))))
