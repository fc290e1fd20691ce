"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from agoraspark.functions import markup

#: Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def folded(text: Column, cyrillic: bool = False) -> Column:
    """Lower case without accents on Latin letters; sharp s becomes ss, and if asked for the Cyrillic yo becomes ye."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), ACCENTED + "ё" * cyrillic, PLAIN + "е" * cyrillic)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def slug(text: Column) -> Column:
    """Folded words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def stripped_html(html: Column) -> Column:
    """Text of a page: without comments, scripts, styles and tags, entities decoded, blanks run together."""
    return markup.stripped(html, ["script", "style"])


def excerpt(text: Column, most: int, least_share: float = 0.6) -> Column:
    """At most `most` characters, cut at the last blank if that leaves least_share of them."""
    cut = F.substring(text, 1, most)
    at = F.char_length(cut) - F.locate(" ", F.reverse(cut))
    short = F.when((F.locate(" ", F.reverse(cut)) > 0) & (at >= least_share * most), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.char_length(text) <= most, text).otherwise(short)


def whole_word(term: str) -> str:
    """A pattern of a term as a whole token; a blank in it stands for a hyphen too, and digits belong to tokens."""
    return r"(?<![a-z0-9])" + r"[\s-]".join(map(re.escape, term.split(" "))) + r"(?![a-z0-9])"


