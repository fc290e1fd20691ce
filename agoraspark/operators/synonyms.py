"""Synonyms of one to several words: entries compiled to a trie of tokens, found in one pass, the longest first."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<concept string, begin int, length int>>"
_TYPE = pa.list_(pa.struct([("concept", pa.string()), ("begin", pa.int32()), ("length", pa.int32())]))
WORDS = 1 << 16
_END = ""  # no token is empty


def tokens(text: Column, dictionary: list[str] = (), inside: str = "") -> Column:
    """Lower-case tokens: entries of a dictionary as they stand, else runs of letters, digits and the characters of inside.

    A dictionary entry may hold separators; it counts where no letter or digit touches its ends. Characters of inside don't
    separate, so that c++ or a hashtag is a token.
    """
    part = rf"[\p{{L}}\p{{N}}{re.escape(inside)}]"
    known = "".join(rf"(?<!{part}){re.escape(d.lower())}(?!{part})|" for d in sorted(dictionary, key=len, reverse=True))
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{known}{part}+"), F.lit(0))


def compiled(entries: dict[str, list[str]], dictionary: list[str] = ()) -> dict:
    """A trie of the token sequences of all entries. entries: concept to its words; its tokens are parted by blanks."""
    root: dict = {}
    for concept, forms in entries.items():
        for form in forms:
            node = root
            for token in form.lower().split(" "):
                node = node.setdefault(token, {})
            if node.setdefault(_END, concept) != concept:
                raise ValueError(f"{form!r} stands for two concepts")
    return root


def found(trie: dict, words: list[str]) -> list[tuple[str, int, int]]:
    """concept, begin and length of the matches in words: at each place the longest, which the next begins after."""
    out, i = [], 0
    while i < len(words):
        node, best, at = trie.get(words[i]), None, i
        while node is not None:
            at += 1
            if _END in node:
                best = (node[_END], i, at - i)
            node = node.get(words[at]) if at < len(words) else None
        out += [best] if best else []
        i += best[2] if best else 1
    return out


def _cut(listed: pa.Array) -> Iterator[pa.Array]:
    """Rows of WORDS words together, or one that has more, as only so many become Python objects at a time."""
    after, first = np.cumsum(listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(listed):
        end = max(first + 1, int(np.searchsorted(after, (after[first - 1] if first else 0) + WORDS, side="right")))
        yield listed.slice(first, end - first)
        first = end


def _matches(trie: dict, rows: list[list[str] | None]) -> pa.Array:
    every = [found(trie, w) if w else [] for w in rows]
    flat = [m for row in every for m in row]
    columns = [pa.array([m[i] for m in flat], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    offsets = np.cumsum([0, *map(len, every)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_TYPE.value_type)), type=_TYPE)


def concepts(words: Column, trie: dict) -> Column:
    """The matches in an array of tokens. A null array has none."""

    @F.arrow_udf(MATCH)
    def run(listed: pa.Array) -> pa.Array:
        return pa.concat_arrays([_matches(trie, piece.to_pylist()) for piece in _cut(listed)] or [pa.array([], _TYPE)])

    return run(words)
