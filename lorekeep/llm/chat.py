"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's layout is told by the hash of its nested field paths. The hash selects a declarative mapping (an SQL expression over
the record) that yields canonical turns: an array of (role, text). Records whose fingerprint has no mapping come back with a null layout,
never dropped. Turns are written with markers, control strings inside texts are escaped reversibly, and the reader gets the
same turns and the loss mask back from the written form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import has_columns

TURNS = "array<struct<role:string,text:string>>"
#: name -> (field paths, SQL expression for the turns of the variant column v).
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].content", "messages[].role"), "transform(cast(v:messages as array<variant>), x -> struct(cast(x:role as string) as role, cast(x:content as string) as text))"),
    "conversations": (("conversations[].from", "conversations[].value"), "transform(cast(v:conversations as array<variant>), x -> struct(cast(x:from as string) as role, cast(x:value as string) as text))"),
    "turns": (("turns[].role", "turns[].text"), "transform(cast(v:turns as array<variant>), x -> struct(cast(x:role as string) as role, cast(x:text as string) as text))"),
    "prompt_response": (("prompt", "response"), "array(struct('user' as role, cast(v:prompt as string) as text), struct('assistant' as role, cast(v:response as string) as text))"),
    "prompt_completion": (("completion", "prompt"), "array(struct('user' as role, cast(v:prompt as string) as text), struct('assistant' as role, cast(v:completion as string) as text))"),
    "question_answer": (("answer", "question"), "array(struct('user' as role, cast(v:question as string) as text), struct('assistant' as role, cast(v:answer as string) as text))"),
    "instruction": (("instruction", "output"), "array(struct('user' as role, cast(v:instruction as string) as text), struct('assistant' as role, cast(v:output as string) as text))"),
    "instruction_input": (
        ("input", "instruction", "output"),
        "array(struct('user' as role, concat_ws('\\n\\n', cast(v:instruction as string), nullif(cast(v:input as string), '')) as text), struct('assistant' as role, cast(v:output as string) as text))",
    ),
    "system_prompt_response": (
        ("prompt", "response", "system"),
        "array(struct('system' as role, cast(v:system as string) as text), struct('user' as role, cast(v:prompt as string) as text), struct('assistant' as role, cast(v:response as string) as text))",
    ),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "prompter": "user"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_AHEAD = r"(?=\||/?s>|<|/?SYS>>|/?INST\])"


def _sql_schema(paths: tuple[str, ...]) -> str:
    """The nested shape of ``paths`` as schema_of_variant spells it, with every scalar as *."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("."):
            at = at.setdefault(part, {})

    def spell(node: dict) -> str:
        if not node:
            return "*"
        return "OBJECT<" + ", ".join(f"{k.removesuffix('[]')}: " + (f"ARRAY<{spell(v)}>" if k.endswith("[]") else spell(v)) for k, v in sorted(node.items())) + ">"

    return spell(tree)


def shape(v: Column) -> Column:
    """The nested field paths of a variant, without the kinds of scalars."""
    return F.regexp_replace(F.schema_of_variant(v), r"(: |ARRAY<)(?:STRING|BIGINT|BOOLEAN|DOUBLE|VOID|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP|FLOAT|BINARY)(?=[,>])", "$1*")


def fingerprint(v: Column) -> Column:
    return F.xxhash64(shape(v))


def turns_from_json(records: DataFrame, json: str = "record") -> DataFrame:
    """``records`` with layout, fingerprint and turns; a record that is null, no JSON or of an unknown shape has a null layout and turns."""
    has_columns(records, json)
    names = [n for n in records.columns if n not in ("layout", "fingerprint", "turns")]
    v = records.select(*names, F.try_parse_json(json).alias("v")).withColumn("fingerprint", fingerprint(F.col("v")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, expression) in LAYOUTS.items():
        same = F.col("fingerprint") == F.xxhash64(F.lit(_sql_schema(paths)))
        layout = F.when(same, name).otherwise(layout)
        turns = F.when(same, F.expr(expression).cast(TURNS)).otherwise(turns)
    out = v.withColumns({"layout": layout, "turns": turns})
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = lambda x: F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.lower(x))), F.lit(0)), F.lower(x), F.lit(""))
    clean = F.transform("turns", lambda x: F.struct(role(x["role"]).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return out.withColumn("turns", clean).drop("v")


#: Layouts of plain tables with a row for each turn: field paths -> (conversation, order, role, text).
ROW_LAYOUTS: dict[tuple[str, ...], tuple[str, str, str, str]] = {
    ("conv_id", "role", "text", "turn"): ("conv_id", "turn", "role", "text"),
    ("content", "conversation_id", "index", "role"): ("conversation_id", "index", "role", "content"),
    ("from", "id", "position", "value"): ("id", "position", "from", "value"),
}


def row_print(columns: list[str]) -> Column:
    """The fingerprint of a row's ``columns``: the hash of the nested field paths of the row as a variant.

    Strings go in cut to a character, as only their paths are told.
    """
    return fingerprint(F.to_variant_object(F.struct(*(F.left(F.col(f"`{c}`").cast("string"), F.lit(1)).alias(c) for c in columns))))


def canonical_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and layout of a table with a row for each turn; the hash of its nested field paths selects each row's mapping.

    A table with further columns has the mapping whose paths are all there: the print is then taken of these alone, in the order of ROW_LAYOUTS.
    A table without any mapping's columns is a ValueError, as no row of it could ever have a mapping.
    """
    fits = {p: m for p, m in ROW_LAYOUTS.items() if set(p) <= set(rows.columns)}
    if not fits:
        raise ValueError(f"no mapping for a table of {sorted(rows.columns)}")
    prints = rows.withColumns({f"__print{i}": row_print(sorted(p)) for i, p in enumerate(fits)})
    turn = "struct<conv_id:long,turn:long,role:string,text:string,layout:string>"
    mapped = F.lit(None).cast(turn)
    for i, (paths, mapping) in reversed(list(enumerate(fits.items()))):
        conv, order, role, text = (F.col(f"`{c}`") for c in mapping)
        declared = F.struct(conv.cast("long").alias("conv_id"), order.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"), F.lit("/".join(paths)).alias("layout"))
        mapped = F.when(F.col(f"__print{i}") == F.xxhash64(F.lit(_sql_schema(paths))), declared).otherwise(mapped)
    return prints.select(mapped.alias("t")).select("t.*")


def turns_from_rows(rows: DataFrame) -> DataFrame:
    """conv_id and turns (in order; ties by role and text) of a table with a row for each turn, whose field paths select the mapping.

    Further columns don't matter as long as one mapping's paths are there. Null roles and texts are empty, rows with a null place come first,
    and rows with a null conversation are one conversation.
    """
    return gathered(canonical_rows(rows))


def gathered(canonical: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    all_ = canonical.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return all_.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escaped(text: Column) -> Column:
    """One backslash more behind the first character of whatever could be read as a control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _AHEAD, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _AHEAD, "$1$2")


def _head(role: Column) -> Column:
    """What stands before a turn's text. Roles are URL-encoded, so they hold no line break or marker."""
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"))


def render(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x["role"]), escaped(x["text"]), F.lit(CLOSE + "\n"))), "")


def loss_mask(turns: Column, trained: str = "assistant") -> Column:
    """Spans (turn, start, stop) of the rendered text that the loss is taken over: code points from the turn's opening marker, the text between its markers.

    Counted from the turn and not from the whole text, so that reading all spans of a long conversation takes one pass.
    """
    spans = F.transform(turns, lambda x, i: F.struct(x["role"].alias("role"), i.alias("turn"), F.length(_head(x["role"])).alias("start"), (F.length(_head(x["role"])) + F.length(escaped(x["text"]))).alias("stop")))
    return F.transform(F.filter(spans, lambda x: x["role"] == trained), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["stop"].alias("stop")))


def _cut(formatted: Column) -> Column:
    """The rendered turns of a text, each with its opening marker; no text between markers holds one, as it is escaped."""
    return F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != ""), lambda x: F.concat(F.lit(OPEN), x))


def read_back(formatted: Column) -> Column:
    """The turns of a text that ``render`` wrote."""
    role = lambda x: F.substring_index(x, "\n", 1)
    # Behind the role's line, without the closing marker and its line break.
    body = lambda x: F.substring(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(CLOSE) - 1)
    return F.transform(_cut(formatted), lambda x: F.struct(F.url_decode(F.substring(role(x), F.lit(len(OPEN) + 1), F.length(x))).alias("role"), unescaped(body(x)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between its spans."""
    # The outer lambda binds the cut turns, which are then made once and not for each span.
    under = lambda turns: F.array_join(F.transform(mask, lambda m: unescaped(F.substring(F.get(turns, m["turn"]), m["start"] + 1, m["stop"] - m["start"]))), "")
    return F.get(F.transform(F.array(_cut(formatted)), under), F.lit(0))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id and what is read back from the columns ``formatted`` and ``mask``: counts and digests of the turns and of the text under the loss mask."""
    read = formatted.withColumns({"read": read_back(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("mask"))})
    said = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_rows(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and mask (the loss spans) of a table with a row for each turn; an empty table gives an empty result."""
    return written(turns_from_rows(rows))


def written(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", render(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("mask"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
