"""Chat formatting, with DataFrame functions only.

Records are JSON texts of any known layout. The nested field paths of a record that mappings know are hashed to a
fingerprint, and the fingerprint selects a declarative mapping from the record to canonical turns (role, text); fields that
no mapping reads, at any depth, are let through and don't matter. A template sets marks around every turn. Control strings
inside texts are escaped with backslashes, so that the turns can be read back from the formatted text alone. A loss mask of
run lengths covers the texts of assistant turns.

Null texts and roles count as empty. A record whose fingerprint no mapping has keeps its row with null turns and mapping; so
does one that is no JSON, whose fingerprint is null as well. Records beyond the size that Spark parses as a variant (about
128 MB) have no fingerprint either; they get the first mapping all of whose fields they have, so long texts aren't lost. A
list without turns gives no turns, and a conversation without turns is formatted as the empty text. Rows of one turn number
are in the order of role and text, so ties have an order; repeated rows of a conversation are turns of their own, and repeated
records give equal results. An empty table gives an empty result. Other columns stay as they are; columns of the names that
are added (fingerprint, mapping, turns, formatted, mask) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts: the paths that a record has ([] for the items of a list), and where its turns stand: a list with its role
#: and text, or single fields with their roles. roles: other names of the canonical roles.
MAPPINGS: dict[str, dict] = {
    "messages": {"paths": ("messages[].content", "messages[].role"), "list": ("messages", "role", "content")},
    "from_value": {"paths": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    "dialog": {"paths": ("dialog.turns[].speaker", "dialog.turns[].text"), "list": ("dialog.turns", "speaker", "text")},
    "prompt": {"paths": ("prompt", "response"), "fields": (("user", "prompt"), ("assistant", "response"))},
    "instruction": {"paths": ("instruction", "output"), "fields": (("user", "instruction"), ("assistant", "output"))},
    "instruction_system": {"paths": ("instruction", "output", "system"), "fields": (("system", "system"), ("user", "instruction"), ("assistant", "output"))},
    "question": {"paths": ("data.answer", "data.question"), "fields": (("user", "data.question"), ("assistant", "data.answer"))},
}

KINDS = r"STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|VARIANT|DECIMAL\(\d+,\d+\)"
DEPTH = 4  # levels of unknown fields within unknown fields that are let through
OPENING = r"\[INST\]|<s>|<<SYS>>|<<ROLE:[^<>\[\]\s]*>>"
CLOSING = r"\[/INST\]|</s>|<</SYS>>|<</ROLE>>"
#: What is escaped inside texts: all marks, and the beginning of the one that carries a name.
CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|<<ROLE:|<</ROLE>>"


def layout_text(paths: tuple[str, ...]) -> str:
    """Field paths as one nested text in the order of names."""
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})

    def text(node: dict) -> str:
        if not node:
            return ""
        listed = lambda n: f"ARRAY<{text(node[n])}>" if n.endswith("[]") else text(node[n])
        return f"OBJECT<{', '.join(f'{n.removesuffix("[]")}: {listed(n)}' for n in sorted(node))}>"

    return text(tree)


def _names() -> str:
    """All field names that mappings know, as alternatives of a pattern."""
    return "|".join(sorted({n.removesuffix("[]") for m in MAPPINGS.values() for path in m["paths"] for n in path.split(".")}))


def known_layout(layout: Column) -> Column:
    """A layout without types and without the fields that no mapping knows; inner ones go first, DEPTH levels at most.

    What holds no fields is written without angles: {} for an object, [] around an array's items.
    """
    out = F.regexp_replace(layout, rf"(?<=[<\s])(?:{KINDS})(?=[,>])", "")
    other = rf"(?!(?:{_names()}): )(?:`(?:[^`]|``)*+`|[^<>,:`\s]+): [\[\]{{}}]*+"
    for _ in range(DEPTH):
        out = F.replace(out, F.lit("OBJECT<>"), F.lit("{}"))
        for _ in range(2):
            out = F.regexp_replace(out, r"ARRAY<([\[\]{}]*+)>", "[$1]")
        # one after another first, then one that stands first, then one that stands alone
        for place in (rf", {other}(?=[,>])", rf"(?<=<){other}, ", rf"(?<=<){other}(?=>)"):
            out = F.regexp_replace(out, place, "")
    return out


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text that mappings know, whatever its values; null for what is no JSON."""
    layout = F.schema_of_variant(F.try_parse_json(record))
    return F.when(layout.isNotNull(), F.xxhash64(known_layout(layout)))


def _known(mapping: dict) -> Column:
    """The fingerprints of a mapping: of its layout, and of its list without items."""
    whole = [F.xxhash64(F.lit(layout_text(mapping["paths"])))]
    if "list" in mapping:
        whole.append(F.xxhash64(F.lit(layout_text((mapping["list"][0] + "[]",)).replace("ARRAY<>", "[]"))))
    return F.array(*whole)


def _schema(mapping: dict) -> str:
    """DDL of the part of a record that a mapping reads."""

    def nested(path: str, kind: str) -> str:
        head, _, rest = path.partition(".")
        return f"`{head}` {kind}" if not rest else f"`{head}` struct<{nested(rest, kind).replace('` ', '`:', 1)}>"

    if "list" in mapping:
        at, role, text = mapping["list"]
        return nested(at, f"array<struct<`{role}`:string,`{text}`:string>>")
    tops: dict[str, list[str]] = {}
    for _, path in mapping["fields"]:
        head, _, rest = path.partition(".")
        tops.setdefault(head, []).append(rest)
    return ", ".join(f"`{h}` string" if rest == [""] else f"`{h}` struct<{','.join(f'`{r}`:string' for r in rest)}>" for h, rest in tops.items())


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, mapping: dict) -> Column:
    parsed = F.from_json(record, _schema(mapping))

    def field(path: str) -> Column:
        out = parsed
        for name in path.split("."):
            out = out.getField(name)
        return out

    if "fields" in mapping:
        return F.array(*(_turn(F.lit(role), field(path)) for role, path in mapping["fields"]))
    at, role, text = mapping["list"]

    def renamed(value: Column) -> Column:
        for theirs, ours in mapping.get("roles", {}).items():
            value = F.when(value == theirs, F.lit(ours)).otherwise(value)
        return value

    return F.transform(field(at), lambda x: _turn(renamed(x.getField(role)), x.getField(text)))


def _fits(record: Column, mapping: dict) -> Column:
    """Whether a JSON text has all fields that a mapping reads."""
    parsed, fits = F.from_json(record, _schema(mapping)), F.lit(True)
    for path in [mapping["list"][0]] if "list" in mapping else [p for _, p in mapping["fields"]]:
        out = parsed
        for name in path.split("."):
            out = out.getField(name)
        fits = fits & out.isNotNull()
    return fits


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds fingerprint, mapping and turns (array of role and text) to rows whose column record is a JSON text."""
    rows = records.withColumn("fingerprint", fingerprint(F.col(record)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for key, mapping in reversed(MAPPINGS.items()):
        hit = F.when(F.col("fingerprint").isNull(), _fits(F.col(record), mapping)).otherwise(F.array_contains(_known(mapping), F.col("fingerprint")))
        name, turns = F.when(hit, F.lit(key)).otherwise(name), F.when(hit, _turns(F.col(record), mapping)).otherwise(turns)
    return rows.withColumn("turns", turns).withColumn("mapping", F.when(F.col("turns").isNotNull(), name))


def escaped(text: Column) -> Column:
    """Every control string gets one backslash before it, and those that stood there already are doubled."""
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)\1\\({CONTROL})", "$1$2")


def _marks(role: Column) -> tuple[Column, Column]:
    other = F.concat(F.lit("<<ROLE:"), F.url_encode(role), F.lit(">>"))
    opening = F.when(role == "user", "[INST]").when(role == "assistant", "<s>").when(role == "system", "<<SYS>>").otherwise(other)
    closing = F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").when(role == "system", "<</SYS>>").otherwise("<</ROLE>>")
    return opening, closing


def formatted(rows: DataFrame) -> DataFrame:
    """Adds formatted and mask to rows with turns.

    mask has (lead, loss, trail) for each turn: how many code points of formatted bear no loss, bear it, bear none.
    """

    def piece(turn: Column, at: Column) -> Column:
        opening, closing = _marks(turn["role"])
        before = F.concat(F.when(at > 0, "\n").otherwise(""), opening, F.lit(" "))
        return F.struct(before.alias("before"), escaped(turn["text"]).alias("body"), F.concat(F.lit(" "), closing).alias("after"), (turn["role"] == "assistant").alias("loss"))

    def runs(p: Column) -> Column:
        body, outer = F.char_length(p["body"]), F.char_length(p["before"])
        return F.struct(F.when(p["loss"], outer).otherwise(outer + body).alias("lead"), F.when(p["loss"], body).otherwise(0).alias("loss"), F.char_length(p["after"]).alias("trail"))

    out = rows.withColumn("_pieces", F.transform("turns", piece))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    return out.withColumns({"formatted": text, "mask": F.transform("_pieces", runs)}).drop("_pieces")


def read_back(rows: DataFrame) -> DataFrame:
    """Adds read_turns (role, text) and loss_text (all text under the mask, unescaped) from formatted and mask alone."""
    whole = rf"(?s)(?<!\\)(?:{OPENING}) .*? (?<!\\)(?:{CLOSING})(?=\n|$)"

    def turn(piece: Column) -> Column:
        mark = F.regexp_extract(piece, rf"^({OPENING}) ", 1)
        close = F.regexp_extract(piece, rf" ({CLOSING})$", 1)
        role = F.when(mark == "[INST]", "user").when(mark == "<s>", "assistant").when(mark == "<<SYS>>", "system").otherwise(F.url_decode(F.regexp_extract(mark, "<<ROLE:(.*)>>", 1)))
        body = F.substring(piece, F.char_length(mark) + 2, F.char_length(piece) - F.char_length(mark) - F.char_length(close) - 2)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    pieces = F.regexp_extract_all("formatted", F.lit(whole), 0)
    # pieces are apart by a line feed, which the mask counts to the later one
    under = F.transform(
        F.arrays_zip(F.col("_pieces").alias("piece"), F.col("mask").alias("run")),
        lambda x, at: unescaped(F.substring(x["piece"], x["run"]["lead"] + F.when(at > 0, 0).otherwise(1), x["run"]["loss"])),
    )
    out = rows.withColumn("_pieces", pieces)
    return out.withColumns({"read_turns": F.transform("_pieces", turn), "loss_text": F.array_join(under, "")}).drop("_pieces")


def as_records(conversations: DataFrame) -> DataFrame:
    """conv_id and record: the rows of each conversation (conv_id, turn, role, text) as one JSON text.

    Every layout is used: pairs and triples of the usual roles go to those of single fields, by conv_id; all others, and
    roles that a layout would rename, to lists. Rows of one turn are in the order of role and text; a null turn is first.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    roles, at = F.transform("rows", lambda r: r["role"]), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    texts = [F.get(F.col("rows"), F.lit(i))["text"] for i in range(3)]
    pair = F.array_join(roles, "\n") == "user\nassistant"
    triple = F.array_join(roles, "\n") == "system\nuser\nassistant"
    plain = ~F.exists(roles, lambda r: r.isin("human", "gpt"))
    theirs = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    listed = lambda role, text, name=lambda r: r: F.transform("rows", lambda r: F.struct(name(r["role"]).alias(role), r["text"].alias(text)))
    record = (
        F.when(triple, F.to_json(F.struct(texts[0].alias("system"), texts[1].alias("instruction"), texts[2].alias("output"))))
        .when(pair & (at == 0), F.to_json(F.struct(texts[0].alias("prompt"), texts[1].alias("response"))))
        .when(pair & (at == 1), F.to_json(F.struct(texts[0].alias("instruction"), texts[1].alias("output"))))
        .when(pair, F.to_json(F.struct(F.struct(texts[0].alias("question"), texts[1].alias("answer")).alias("data"))))
        .when((at == 1) & plain, F.to_json(F.struct(listed("from", "value", theirs).alias("conversations"))))
        .when(at == 2, F.to_json(F.struct(F.struct(listed("speaker", "text").alias("turns")).alias("dialog"))))
        .otherwise(F.to_json(F.struct(listed("role", "content").alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))
