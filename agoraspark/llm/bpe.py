"""Byte-level BPE by a lazily determinised transducer.

The ranks are compiled into a trie of token bytes. For each prefix of a piece exactly one token ends its encoding; so
a piece's encoding is the one path through the trie on which every pair of neighbours is stable (encoding the two
tokens' joined bytes gives back the pair). The machine reads bytes from left to right and follows every live
hypothesis: a last token and a place in the trie. Sets of hypotheses are made into states when they are first met, and
kept with their moves in a bounded table, as lazy automata do. A hypothesis begins no farther back than the longest token
is long. After every EMIT_BYTES bytes the tokens on which all live hypotheses agree leave the machine and are forgotten, so
a piece of any length is encoded with memory for that block and the lookahead; a shorter piece leaves at its end.

Decoding joins token bytes, block by block, and feeds an incremental UTF-8 state machine; the digest of what was decoded is
that of the characters which come out of it.

Null texts count as empty: no ids, and the digest of nothing. Texts are encoded whole however long. Pairs of equal rank are
joined from left to right. Pieces are split by the Unicode tables of the regex module, so letters that another library's
tables don't know yet may be split otherwise there. Repeated rows give repeated, equal results; a null doc_id stays null. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from agoraspark.llm.common import worker_tool

MAX_STATES = 200_000
MAX_PAIRS = 170_000
MAX_PIECES = 120_000
LONGEST_KEPT = 48
DECODE_BLOCK = 8192
EMIT_BYTES = 1024
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes pieces (bytes) to token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.sizes = {r: len(b) for b, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, dict[int, list[tuple[bytes, int]]]] = {0: {}, -1: {}}
        for token, rank in ranks.items():
            if len(token) > 1 and self.merged(token) != [token]:
                continue  # only a whole piece can be this token
            node = 0
            for byte in token:
                step = self.children[node].get(byte)
                if step is None:
                    step = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = step
            self.token_at[node] = rank
        self.reset()

    def merged(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """Encoding by the definition: join the leftmost pair of lowest rank until none is left. For single tokens."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at a token's left (0) or right (-1) edge while it is put together, each with the rank that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            data = self.tokens[token]
            known = [(data, NEVER)]
            if len(data) > 1:
                part = self.merged(data, 2)[side]
                below = self.spine(self.ranks[part], side)
                known += [(part, token), *below[1:]]
            self.spines[side][token] = known
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether right can follow left in an encoding: no join across their boundary comes before those that end both its parts.

        Joins of equal rank go from left to right.
        """
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ranks, known = self.ranks, True
            after = self.spine(right, 0)
            for a, end_a in self.spine(left, -1):
                for b, end_b in after:
                    rank = ranks.get(a + b)
                    if rank is not None and rank < end_a and rank <= end_b:
                        known = False
                        break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def reset(self) -> None:
        """Forget the states made so far."""
        self.ids: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.moves: dict[int, tuple[int, int]] = {}  # by 256 * state + byte
        self.start = self.intern((0,))

    def intern(self, state: tuple[int, ...]) -> int:
        known = self.ids.get(state)
        if known is None:
            known = self.ids[state] = 256 * len(self.states)
            self.states.append(state)
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte, and the token that ends the encoding so far.

        A hypothesis is (the token before, plus 1) << 24 | a trie node.
        """
        children, token_at, grown, last = self.children, self.token_at, [], -1
        for one in self.states[state >> 8]:
            step = children[one & 0xFFFFFF].get(byte)
            if step is None:
                continue
            before = one >> 24
            if children[step]:
                grown.append(before << 24 | step)
            token = token_at[step]
            if last < 0 <= token and (not before or self.stable(before - 1, token)):
                last = token
        grown.append(last + 1 << 24)
        return self.intern(tuple(grown)), last

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > EMIT_BYTES:
            return list(self.stream(piece[i : i + EMIT_BYTES] for i in range(0, len(piece), EMIT_BYTES)))
        _, ends = self.advance(self.start, piece)
        return self.path(ends, len(ends), 0)

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece (that isn't a token itself) given in blocks, each as soon as a block shows that it is final."""
        state, ends = self.start, []
        for block in blocks:
            state, more = self.advance(state, block)
            ends += more
            done = self.agreed(state, ends)
            yield from self.path(ends, done, 0)
            del ends[:done]
        yield from self.path(ends, len(ends), 0)

    def advance(self, state: int, block: bytes) -> tuple[int, list[int]]:
        """The state after some bytes, and for each of them the token that ends the encoding there if the piece ends there."""
        if len(self.states) > MAX_STATES:
            keep = self.states[state >> 8]
            self.reset()
            state = self.intern(keep)
        moves, ends = self.moves, []
        push, rest = ends.append, iter(block)
        while True:
            try:
                for byte in rest:
                    state, last = moves[state | byte]
                    push(last)
                return state, ends
            except KeyError:  # a move that wasn't made yet; the state is still the one before it
                byte = block[len(ends)]
                step = moves[state | byte] = self.move(state, byte)
                state = step[0]
                push(step[1])

    def agreed(self, state: int, ends: list[int]) -> int:
        """Up to which place of ends all live hypotheses take the same path: the least place from which each of them has come."""
        depth, sizes, here = self.depth, self.sizes, len(ends)
        begins = {here - depth[one & 0xFFFFFF] for one in self.states[state >> 8]}
        while len(begins) > 1:  # the farthest goes back by its last token until all have met
            far = max(begins)
            begins.remove(far)
            begins.add(max(0, far - sizes[ends[far - 1]]))
        return begins.pop()

    def path(self, ends: list[int], stop: int, start: int) -> list[int]:
        """The tokens of the one path from start to stop."""
        out, sizes = [], self.sizes
        while stop > start:
            token = ends[stop - 1]
            out.append(token)
            stop -= sizes[token]
        out.reverse()
        return out


class Codec:
    """Encodes and decodes texts: splits by a pattern, runs the transducer, remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        known, machine = self.known, self.machine
        for piece in self.split(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = tuple(machine.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= LONGEST_KEPT:
                    if len(known) >= MAX_PIECES:  # those that were met since the last time stay within reach
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = ids
            out += ids
        return out

    def decode_blocks(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Bytes of the ids, a block of tokens at a time."""
        table = self.machine.tokens.__getitem__
        ids = list(ids)
        for i in range(0, len(ids), DECODE_BLOCK):
            yield b"".join(map(table, ids[i : i + DECODE_BLOCK]))


# Fixed values of UTF-8: the ranges of first bytes, each with the states of the bytes that must follow; and for each state
# the range of bytes that leads on. State 0 is between characters; A is any continuation byte.
FIRST_BYTES = (
    (0x00, 0x7F, ""),
    (0xC2, 0xDF, "A"),
    (0xE0, 0xE0, "BA"),
    (0xE1, 0xEC, "AA"),
    (0xED, 0xED, "CA"),
    (0xEE, 0xEF, "AA"),
    (0xF0, 0xF0, "DAA"),
    (0xF1, 0xF3, "AAA"),
    (0xF4, 0xF4, "EAA"),
)
_HIGH = re.compile(rb"[\x80-\xff]")
NEXT_BYTES = {"A": (0x80, 0xBF), "B": (0xA0, 0xBF), "C": (0x80, 0x9F), "D": (0x90, 0xBF), "E": (0x80, 0x8F)}


@lru_cache(1)
def utf8_moves() -> list[list[int]]:
    """The transition table: for each state and byte the next state, or -1 where the byte can't stand. State 0 accepts."""
    states = sorted({row[2][k:] for row in FIRST_BYTES for k in range(len(row[2]) + 1)}, key=lambda s: (len(s), s))
    table = [[-1] * 256 for _ in states]
    for low, high, rest in FIRST_BYTES:
        for byte in range(low, high + 1):
            table[0][byte] = states.index(rest)
    for i, state in enumerate(states[1:], 1):
        low, high = NEXT_BYTES[state[0]]
        for byte in range(low, high + 1):
            table[i][byte] = states.index(state[1:])
    return table


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any portions, gives the characters that are complete.

    The state goes from byte to byte by utf8_moves; runs of ASCII are passed over at once where no character is open. A
    byte that can't stand ends the character that is open, which becomes U+FFFD, and so does such a byte itself unless it
    can begin a character.
    """

    def __init__(self) -> None:
        self.state, self.open = 0, b""  # open: the bytes of a character that isn't complete

    def feed(self, data: bytes) -> str:
        moves, buf = utf8_moves(), self.open + data
        state, begin, at, done, out = self.state, 0, len(self.open), 0, []
        while True:
            if not state:
                high = _HIGH.search(buf, at)
                if high is None:
                    begin = len(buf)
                    break
                begin, at = high.start(), high.end()
                state = moves[0][buf[begin]]
            while state > 0 and at < len(buf) and (step := moves[state][buf[at]]) >= 0:
                state, at = step, at + 1
            if state > 0 and at == len(buf):
                break
            if state:  # the byte at hand can't go on with the character, or can't begin one
                out.append(buf[done:begin].decode() + "\ufffd")
                state, done = 0, at
        out.append(buf[done:begin].decode())
        self.state, self.open = state, buf[begin:]
        return "".join(out)

    def finish(self) -> str:
        out = "\ufffd" if self.state else ""
        self.state, self.open = 0, b""
        return out


@worker_tool
def codec(path: str, pattern: str) -> Codec:
    """A worker's codec, kept between batches and tasks, until the worker begins work of another kind."""
    made = Codec(read_ranks(path), pattern)
    gc.freeze()  # the trie stays, so the collector needn't walk it again and again
    return made


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, n_chars_decoded long"
_KINDS = [pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int64()]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    doc_id, n_tokens, ids (null unless keep_ids), digests of the ids and of the decoded text's bytes, characters decoded.
    The ranks are a vocabulary file that every executor can open at ranks_path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "n_chars_decoded"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for value in part.column(1):
                    ids = tool.encode(value.as_py())
                    digest, stream, chars = hashlib.sha256(), Utf8Stream(), 0
                    for data in tool.decode_blocks(ids):
                        text = stream.feed(data)
                        digest.update(text.encode())
                        chars += len(text)
                    rest = stream.finish()
                    digest.update(rest.encode())
                    chars += len(rest)
                    rows.append((len(ids), ids if keep_ids else None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), digest.hexdigest(), chars))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True))], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, ENCODED_SCHEMA)
