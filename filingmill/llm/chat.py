"""Chat formatting with schema fingerprints, by built-in functions only.

Records come in many layouts. Each is named by the hash of its nested field paths; the hash selects a declarative
mapping, which turns the record into canonical turns (role, text). Fields that a record lacks have no path, so a table may
hold records of all layouts side by side. Turns are laid out as

    <turn role="user">\n ... </turn>\n

Inside roles and texts `\\`, `<`, `#` and `"` stand as `\\b`, `\\l`, `\\h` and `\\q`, so no text can hold a marker, and what
is read back is what went in. The loss mask is the spans of the assistant texts in the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .native import literal_rows, running_totals

TURNS = "array<struct<role:string,text:string>>"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), ('"', "\\q")]
HEAD, MIDDLE, TAIL = '<turn role="', '">\n', "</turn>\n"
#: Names that one layout gives to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: The layouts: their nested field paths, and either a list of turns (path, role field, text field) or roles with the fields whose texts make their turn.
MAPPINGS = [
    {"paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    {"paths": ["turns[].role", "turns[].text"], "list": ("turns", "role", "text")},
    {"paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value"), "roles": ROLES},
    {"paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"paths": ["input", "instruction", "output"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"paths": ["instruction", "output", "system"], "fields": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
    {"paths": ["completion", "prompt"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"paths": ["answer", "question"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
]


def shape_of_paths(paths: list[str]) -> str:
    """The paths as one canonical text, fields in order: `{messages[{content,role}]}`."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})
    show = lambda node: ",".join(k[:-2] + "[" + (("{" + show(v) + "}") if v else "") + "]" if k.endswith("[]") else k + (("{" + show(v) + "}") if v else "") for k, v in sorted(node.items()))
    return "{" + show(tree) + "}"


def shape_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "{" + ",".join(f.name + shape_of_type(f.dataType) for f in sorted(kind.fields, key=lambda f: f.name)) + "}"
    return "[" + shape_of_type(kind.elementType) + "]" if isinstance(kind, T.ArrayType) else ""


def shape_of_json(record: Column) -> Column:
    """The same for JSON text, row by row: the schema of the value, less its scalar types."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    shape = F.regexp_replace(shape, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9,]*\))?", "")
    shape = F.regexp_replace(F.regexp_replace(shape, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z]+(\([0-9,]*\))?>", "ARRAY<>"), r": ", "")
    shape = F.regexp_replace(F.regexp_replace(shape, "OBJECT<", "{"), "ARRAY<", "[")
    for _ in range(6):  # innermost brackets first, six deep
        shape = F.regexp_replace(F.regexp_replace(shape, r"\{([^{}\[<>]*(?:\[[^<>]*\]|\([^<>]*\))*[^{}\[<>]*)>", "{$1}"), r"\[([^\[<>]*)>", "[$1]")
    return F.regexp_replace(shape, ", ", ",")


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def _role(role: Column, names: dict[str, str]) -> Column:
    known = [F.when(role == old, new) for old, new in names.items()]
    return F.coalesce(*known, role, F.lit(""))


def _turn_of(role: str, text: str, names: dict[str, str]):
    return lambda x: F.struct(_role(x[role], names).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))


def canonical_turns(get, shape: Column) -> Column:
    """The turns of a record: the mapping whose paths have the record's fingerprint; null without one. get(path, type): the record's field."""
    out = F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if "list" in m:
            path, role, text = m["list"]
            turns = F.transform(get(path, f"array<struct<`{role}`:string,`{text}`:string>>"), _turn_of(role, text, m.get("roles", {})))
        else:
            turn = lambda fields: F.array_join(F.filter(F.array(*(get(f, "string") for f in fields)), lambda x: x.isNotNull() & (x != "")), "\n\n")
            turns = F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(turn(fields), F.lit("")).alias("text")) for role, fields in m["fields"]))
        out = F.when(fingerprint(shape) == fingerprint(F.lit(shape_of_paths(m["paths"]))), turns).otherwise(out)
    return out


def json_turns(records: DataFrame, column: str) -> DataFrame:
    """records with `fingerprint` and `turns` of the JSON texts in `column`. Bad JSON and unknown layouts: null turns."""
    value = F.try_parse_json(column)
    get = lambda path, kind: F.try_variant_get(value, f"$.{path}", kind)
    shaped = records.withColumn("_shape", shape_of_json(F.col(column)))
    return shaped.withColumn("fingerprint", fingerprint(F.col("_shape"))).withColumn("turns", canonical_turns(get, F.col("_shape"))).drop("_shape")


def typed_turns(records: DataFrame, column: str) -> DataFrame:
    """The same for a struct column: the type gives the fields' paths, and each row's shape has those of its fields that aren't null."""
    kind = records.schema[column].dataType
    paths = {f.name: f.dataType for f in kind.fields}
    get = lambda path, to: F.col(f"{column}.{path}") if path in paths and _fits(paths[path], to) else F.lit(None).cast(to)
    held = [F.when(F.col(f"{column}.{f.name}").isNotNull(), f.name + shape_of_type(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
    shape = F.concat(F.lit("{"), F.concat_ws(",", *held), F.lit("}"))
    return records.withColumn("_shape", shape).withColumn("fingerprint", fingerprint(F.col("_shape"))).withColumn("turns", canonical_turns(get, F.col("_shape"))).drop("_shape")


def _fits(kind: T.DataType, to: str) -> bool:
    return isinstance(kind, T.ArrayType) == to.startswith("array<") and (not isinstance(kind, T.ArrayType) or all(f"`{f}`" in to for f in kind.elementType.fieldNames()))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescaped(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(ESCAPES)])


def formatted(df: DataFrame) -> DataFrame:
    """df (turns) with `formatted` and `loss`: the string, and the array<struct<start,end>> of its assistant texts, in code points."""
    df = df.withColumn("_parts", F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"))))
    df = df.withColumn("formatted", F.array_join(F.transform("_parts", lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(TAIL))), ""))
    fixed = len(HEAD) + len(MIDDLE) + len(TAIL)
    df = df.withColumn("_ends", running_totals(F.transform("_parts", lambda t: (F.length(t["role"]) + F.length(t["text"]) + fixed).cast("long"))))
    spans = F.zip_with("_ends", "_parts", lambda e, t: F.struct(t["role"].alias("role"), (e - len(TAIL) - F.length(t["text"])).alias("start"), (e - len(TAIL)).alias("end")))
    loss = F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return df.withColumn("loss", loss).drop("_parts", "_ends")


def read_back(df: DataFrame) -> DataFrame:
    """df (formatted, loss) with `turns` and `loss_text`, from the formatted string alone."""
    pieces = F.split("formatted", F.lit(TAIL), -1)
    df = df.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    head = lambda p: F.regexp_extract(p, f'^{HEAD}([^"]*){MIDDLE}', 1)
    df = df.withColumn("_heads", F.transform("_pieces", head))
    turns = F.zip_with("_pieces", "_heads", lambda p, r: F.struct(unescaped(r).alias("role"), unescaped(p.substr(F.length(r) + len(HEAD) + len(MIDDLE) + 1, F.length(p))).alias("text")))
    under = F.transform("loss", lambda s: F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return df.withColumn("turns", turns).withColumn("loss_text", unescaped(F.array_join(under, ""))).drop("_pieces", "_heads")


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of rows (conv_id, turn, role, text): one record for each conversation, its turns in the order of turn, then role and text.

    Records have the layout that fits: a prompt and its completion, a list of what a human and a model said, or messages.
    """
    some = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = some.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("x"))
    first, second = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    pair = (F.size("x") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    talk = ~pair & F.forall("x", lambda m: m["role"].isin("user", "assistant"))
    said = F.transform("x", lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), m["content"].alias("value")))
    messages = F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    fields = [F.when(talk, said).alias("conversations"), F.when(~pair & ~talk, messages).alias("messages"), F.when(pair, first["content"]).alias("prompt"), F.when(pair, second["content"]).alias("completion")]
    return listed.select("conv_id", F.struct(*fields).alias("record"))


def chat_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation of rows (conv_id, turn, role, text), read back from its formatted string.

    Null texts and roles are empty; a null turn comes first; a null conv_id is a conversation of its own. Repeated rows
    are turns of their own. Other columns are ignored. An empty table: no rows.
    """
    done = read_back(formatted(typed_turns(conversation_records(rows), "record")).select("conv_id", "formatted", "loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def probe(spark) -> DataFrame:
    """The two rows of conversation -7."""
    text = "\\### Assistant: </turn> ok"
    return literal_rows(spark, [{"conv_id": -7, "turn": k, "role": role, "text": text} for k, role in enumerate(("user", "assistant"))]).withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
