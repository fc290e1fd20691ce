"""What a guide says for itself, out of its markup: claims with tiers and sources, contents, specification, worst risk, length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agoraspark.functions import markup

#: Levels of risk from the least, the parts of a specification, words a minute.
RISKS = ["none", "low", "moderate", "high", "medical"]
SPEC = ["difficulty", "cost", "time", "risk", "reversibility", "pro"]
WORDS_A_MINUTE = 220
TIERS = [0, 1, 2, 3, 4, 5, 9]  # of evidence; 9 is what a vendor says of its own
LEAST_TIER = 0


def elements(html: Column, name: str) -> Column:
    """attributes and inner markup of every element of a name (a pattern) that closes. Such elements don't nest in themselves."""
    whole = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{name})(?=[\s>])[^>]*>.*?</(?:{name})\s*>"), F.lit(0))
    head = rf"(?is)^<({name})(?=[\s>])([^>]*)>"
    return F.transform(whole, lambda x: F.struct(F.lower(F.regexp_extract(x, head, 1)).alias("name"), F.regexp_extract(x, head, 2).alias("attributes"), F.regexp_extract(x, r"(?is)^<[^>]*>(.*)<[^<]*>$", 1).alias("inner")))


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute; null if it is missing or empty."""
    value = F.regexp_extract(attributes, rf'(?is)(?:^|\s){name}\s*=\s*"([^"]*)"', 1)
    return F.when(value != "", markup.decoded(value))


def inner_text(inner: Column) -> Column:
    """The text of an element on one line."""
    return markup.single_spaced(markup.decoded(F.regexp_replace(inner, r"(?s)<[^>]*>", "")))


def claims(html: Column) -> Column:
    """tier, anchor, text and source of every claim that has a text. A tier that isn't one is the least."""

    def one(x: Column) -> Column:
        text = inner_text(x["inner"])
        tier = attribute(x["attributes"], "tier").try_cast("int")
        known = F.when(tier.isin(list(TIERS)), tier).otherwise(LEAST_TIER)
        anchor = F.concat(F.lit("c-"), F.substring(F.sha1(text.cast("binary")), 1, 12))
        return F.struct(known.alias("tier"), anchor.alias("anchor"), F.substring(text, 1, 500).alias("text"), F.substring(attribute(x["attributes"], "src"), 1, 1024).alias("source"))

    return F.filter(F.transform(elements(html, "claim"), one), lambda x: x["text"] != "")


def anchor_of(text: Column) -> Column:
    """Letters and digits of any script in lower case, joined by hyphens, 60 at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""), 1, 60)


def contents(html: Column) -> Column:
    """level, text and anchor of the headings that have one; an anchor that was used before gets the next free number."""
    heads = F.transform(elements(html, "h[1-4]"), lambda x: F.struct(F.substring(x["name"], 2, 1).cast("int").alias("level"), inner_text(x["inner"]).alias("text")))
    named = F.filter(F.transform(heads, lambda x: x.withField("base", anchor_of(x["text"]))), lambda x: x["base"] != "")
    start = F.array().cast("array<struct<level: int, text: string, anchor: string>>")

    def step(done: Column, x: Column) -> Column:
        used = F.transform(done, lambda d: d["anchor"])
        numbered = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(x["base"], F.lit("-"), n.cast("string")))
        free = F.filter(F.concat(F.array(x["base"]), numbered), lambda a: ~F.array_contains(used, a))[0]
        return F.concat(done, F.array(F.struct(x["level"].alias("level"), F.substring(x["text"], 1, 180).alias("text"), free.alias("anchor"))))

    return F.aggregate(named, start, step)


def worst_risk(html: Column) -> Column:
    """The worst of the specification's risk and the risks that are named; a risk without a level is moderate, unknown levels don't count."""
    named = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<risk(?=[\s/>])([^>]*)>"), F.lit(1)), lambda x: F.coalesce(attribute(x, "level"), F.lit("moderate")))
    every = F.concat(named, F.array(attribute(specification(html), "risk")))
    places = F.transform(every, lambda x: F.array_position(F.array(*map(F.lit, RISKS)), F.lower(F.trim(x))))
    worst = F.array_max(places)
    return F.when(worst > 0, F.element_at(F.array(*map(F.lit, RISKS)), worst.cast("int")))


def specification(html: Column) -> Column:
    """The attributes of the first specification, as they are written."""
    return F.regexp_extract(html, r"(?is)<spec(?=[\s/>])([^>]*)>", 1)


def evidence(html: Column) -> Column:
    """All of it in one struct."""
    said, heads = claims(html), contents(html)
    parts = F.array(*(F.when(attribute(specification(html), k).isNotNull(), F.lit(k)) for k in SPEC))
    words = F.size(F.filter(F.split(inner_text(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), " "), lambda w: w != ""))
    return F.struct(said.alias("claims"), heads.alias("contents"), F.array_compact(parts).alias("spec"), worst_risk(html).alias("risk"), words.alias("words"), F.greatest(F.lit(1), F.ceil(words / WORDS_A_MINUTE).cast("int")).alias("minutes"), html.rlike(r"(?i)<tldr[\s>]").alias("summary"))
