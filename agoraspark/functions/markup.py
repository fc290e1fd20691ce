"""Text out of markup, as column expressions: subtrees that aren't wanted are left out whole, however deep they are nested.

A page is cut at the tags of unwanted elements only. A fold over these tags follows the depth: the first one that opens begins what
is left out, tags of its own name within count up and down, and all others are ignored until it closes. An element that never closes
takes what follows it; a closing tag without an opening one does nothing. All is within a row and in time linear in its text.
"""

from __future__ import annotations

import sys
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose whole subtree isn't what its author says.
UNWANTED = ["quote", "blockquote", "spoiler", "code", "pre", "script", "style"]
BLOCKS = ["p", "div", "li", "h[1-6]", "tr", "br"]
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def kept_pieces(html: Column, unwanted: list[str]) -> Column:
    """The pieces of html outside the unwanted elements, in order, with what tags there are in them."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?(-->|$)", "")
    tag = rf"(?is)<(/?(?:{'|'.join(unwanted)}))(?=[\s/>])[^>]*>"
    names = F.transform(F.regexp_extract_all(bare, F.lit(tag), F.lit(1)), lambda x: F.lower(x))
    start = F.struct(F.lit("").alias("within"), F.lit(0).alias("depth"), F.array().cast("array<boolean>").alias("kept"))

    def step(state: Column, name: Column) -> Column:
        closes = name.startswith("/")
        depth = state["depth"]
        own = F.ltrim(name, F.lit("/")) == state["within"]
        depth = F.when(depth == 0, F.when(closes, 0).otherwise(1)).when(own & closes, depth - 1).when(own, depth + 1).otherwise(depth)
        within = F.when((state["depth"] == 0) & ~closes, name).otherwise(state["within"])
        return F.struct(within.alias("within"), depth.alias("depth"), F.concat(state["kept"], F.array(depth == 0)).alias("kept"))

    kept = F.concat(F.array(F.lit(True)), F.aggregate(names, start, step)["kept"])
    return F.filter(F.zip_with(F.split(bare, tag), kept, lambda piece, keep: F.when(keep, piece)), lambda piece: piece.isNotNull())


def decoded(text: Column) -> Column:
    """Entities as the characters that they stand for, each once; what is no entity stays."""
    named = F.create_map(*(F.lit(x) for name, code in name2codepoint.items() for x in (f"&{name};", chr(code))), F.lit("&apos;"), F.lit("'"))

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.lpad(F.when(piece.rlike("^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16)), 8, "0")
        value = F.conv(code, 16, 10).cast("long")
        valid = value.between(1, sys.maxunicode) & ~value.between(0xD800, 0xDFFF)
        number = F.when(piece.startswith("&#") & (digits != "") & valid, F.decode(F.unhex(code), "UTF-32"))
        return F.when(piece.startswith("&") & piece.endswith(";") & (F.length(piece) > 2), F.coalesce(F.try_element_at(named, piece), number, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){ENTITY}|[^&]+|&"), F.lit(0))
    return F.when(F.locate("&", text) == 0, text).otherwise(F.array_join(F.transform(pieces, one), ""))


def single_spaced(text: Column) -> Column:
    """Blanks of any kind run together to one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def stripped(html: Column, unwanted: list[str] | None = None) -> Column:
    """The text of html outside the unwanted elements on one line; tags count as blanks, entities are decoded."""
    joined = F.array_join(kept_pieces(html, unwanted or UNWANTED), " ")
    return single_spaced(decoded(F.regexp_replace(joined, r"(?s)<[^>]*>", " ")))


def _accents() -> tuple[str, str]:
    """Letters that are another with marks, and those letters, by the rule of their decomposition."""
    found = {}
    for code in range(0xC0, 0x2000):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks):
            found[chr(code)] = first
    return "".join(found), "".join(found.values())


def without_accents(text: Column) -> Column:
    """Letters without their marks."""
    marked, plain = _accents()
    return F.regexp_replace(F.translate(text, marked, plain), r"\p{Mn}+", "")


def normalised(html: Column) -> Column:
    """Text of html for matching: as stripped, without addresses, in lower case, without accents."""
    return single_spaced(without_accents(F.lower(F.regexp_replace(stripped(html), r"(?i)\bhttps?://\S+", " "))))


def marked_words(text: Column, terms: list[str]) -> Column:
    """Text escaped for HTML, with each run of letters that is one of terms (lower case) in a mark.

    Runs are escaped one by one, so a mark never falls into an entity, and neighbours are marked each.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(?s)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.when(F.lower(run).isin(terms), F.concat(F.lit("<mark>"), run, F.lit("</mark>"))).otherwise(escaped(run))), "")


def escaped(text: Column) -> Column:
    """Text for HTML: the five characters that mean something there as entities."""
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def marked_crop(text: Column, terms: list[str], most: int, lead: int = 5) -> Column:
    """marked and words: a crop of `most` words that begins `lead` words before the first match, escaped and marked."""
    w = F.split(single_spaced(text), " ")
    holds = lambda word: F.exists(F.regexp_extract_all(F.lower(word), F.lit(r"\p{L}+"), F.lit(0)), lambda run: run.isin(terms))
    hit = F.array_position(F.transform(w, holds), True)
    begin = F.greatest(F.when(hit > 0, hit).otherwise(1) - lead, F.lit(1)).cast("int")
    body = marked_words(F.array_join(F.slice(w, begin, F.lit(most)), " "), terms)
    whole = F.concat(F.when(begin > 1, "… ").otherwise(""), body, F.when(F.size(w) > begin + most - 1, " …").otherwise(""))
    return F.struct(whole.alias("marked"), F.least(F.size(w) - begin + 1, F.lit(most)).alias("words"))
