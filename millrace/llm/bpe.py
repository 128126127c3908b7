"""Problem 8: encoding with a byte-level BPE of ranks, by a lazily determinised finite-state transducer.

The rank file is compiled into a byte trie of the tokens. A sequence of tokens is the encoding of its bytes exactly if
each token and each two neighbours are encodings of theirs, so a transducer that reads bytes and keeps, for every
start of an unfinished token, the one valid encoding before it, needs to test neighbours only. Its states (sets of trie
node, last token and tokens not yet certain) are determinised when first met and interned; a step emits the tokens that
all members of the set agree on, which they do once no token of the vocabulary can reach further back (bounded
lookahead). Text is first parted by the vocabulary's public pattern; each part runs through the transducer.

Null and empty texts give an empty list of ids. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Fixed value: the public pattern that parts text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_STATES = 150_000
MAX_WORDS = 150_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes in, token ids out. Interned states and transitions grow as text needs them, up to MAX_STATES."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        nodes = 1
        child = self.child
        for piece, rank in ranks.items():
            at = 0
            for byte in piece:
                key = at << 8 | byte
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = nodes
                    nodes += 1
                at = nxt
            self.token[at] = rank
        self.pairs: dict[int, bool] = {}
        self.halves_of: dict[int, tuple[int, int]] = {}
        self._reset()

    def _reset(self) -> None:
        self.members: list[tuple] = [((0, -1, ()),)]
        self.number: dict[tuple, int] = {self.members[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _restart(self, state: int) -> tuple[int, dict]:
        """Forget all states but this one; its new number and the new table of steps."""
        held = self.members[state]
        self._reset()
        if held not in self.number:
            self.number[held] = len(self.members)
            self.members.append(held)
        return self.number[held], self.steps

    def merged(self, piece: bytes) -> list[int]:
        """The merges by definition, lowest rank first; for single tokens and pairs only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` joins; a single byte is both its halves; (-1, -1) where the
        merges of its bytes do not end in it."""
        known = self.halves_of.get(token)
        if known is None:
            piece, ranks = self.bytes_of[token], self.ranks
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                best, at = min([(ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)])
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = (token, token) if len(parts) == 1 else (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
            self.halves_of[token] = known
        return known

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` can follow ``last`` (-1: the beginning) in an encoding.

        Two encodings side by side stay as they are if no merge across their border comes before the merges that took the
        border's tokens away: both tokens are undone in the order of their ranks, and each pair at the border is looked up.
        """
        if last < 0:
            return self.halves(token)[0] >= 0
        key = last << 32 | token
        known = self.pairs.get(key)
        if known is None:
            known = self.halves(token)[0] >= 0 and self._stay(last, token)
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _stay(self, a: int, b: int) -> bool:
        ranks, text, before = self.ranks, self.bytes_of, 1 << 60
        while True:
            if ranks.get(text[a] + text[b], 1 << 60) < before:
                return False
            for left in (True, False) if a > b else (False, True):  # undo the later merge, else the other
                half = self.halves(a)[1] if left else self.halves(b)[0]
                if half != (a if left else b):
                    before = a if left else b + 1  # of equal ranks the merge further left comes first
                    a, b = (half, b) if left else (a, half)
                    break
            else:
                return True

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: the next state and the tokens that became certain."""
        out, root = [], None
        for node, last, pending in self.members[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            out.append((nxt, last, pending))
            token = self.token.get(nxt)
            if token is not None and root is None and self.fits(last, token):
                root = (0, token, pending + (token,))
        out.append(root)
        sure = out[0][2]
        for _, _, pending in out[1:]:
            k = 0
            while k < len(sure) and k < len(pending) and sure[k] == pending[k]:
                k += 1
            sure = sure[:k]
        key = tuple((n, last, pending[len(sure) :]) for n, last, pending in out)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.members)
            self.members.append(key)
        done = self.steps[state << 8 | byte] = (number, sure)
        return done

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one part of the text."""
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            known = steps.get(state << 8 | byte)
            if known is None:
                if len(self.members) > MAX_STATES:  # also inside a part, however long
                    state, steps = self._restart(state)
                known = self.step(state, byte)
            state, sure = known
            if sure:
                out.extend(sure)
        for node, _, pending in self.members[state]:
            if node == 0:
                out.extend(pending)
        return tuple(out)


class Encoder:
    """Texts to ids with a cache of the parts met before."""

    def __init__(self, path: str = DEFAULT_PATH, pattern: str = PATTERN):
        self.machine = Transducer(load_ranks(path))
        self.parts = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.widths = np.zeros(max(self.machine.bytes_of) + 1, np.int64)  # bytes of each token
        for i, piece in self.machine.bytes_of.items():
            self.widths[i] = len(piece)

    def part_ids(self, part: str) -> tuple[int, ...]:
        ids = self.known.get(part)
        if ids is None:
            ids = self.machine.encode(part.encode())
            if len(part) < 64:
                if len(self.known) > MAX_WORDS:
                    self.known.clear()
                self.known[part] = ids
        return ids

    def encode(self, text: str | None) -> array:
        out = array("i")
        if text:
            known, part_ids, extend = self.known, self.part_ids, out.extend
            for part in self.parts(text):
                extend(known.get(part) or part_ids(part))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, part_ids = self.known, self.part_ids
        return sum([len(known.get(p) or part_ids(p)) for p in self.parts(text)])


def shared(path: str) -> str:
    """Send a vocabulary file of the driver to all workers, once a session and path; returns the path."""
    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.exists(path) and not spark.sparkContext.master.startswith("local["):
        if os.path.basename(path) not in {os.path.basename(str(x)) for x in spark.sparkContext.listFiles}:
            spark.sparkContext.addFile(path)
    return path


@functools.cache
def encoder(path: str = DEFAULT_PATH) -> Encoder:
    """One encoder per Python worker and vocabulary: the file at the path, else the one the driver has sent."""
    where = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    if not os.path.exists(where):
        raise FileNotFoundError(f"vocabulary file {path} is missing; pass its path")
    return Encoder(where)


class Utf8Stream:
    """Incremental UTF-8 decoder: feed bytes, get the characters that are complete; broken bytes become U+FFFD.

    The state is the code point so far, the continuation bytes still due and the bounds of the next byte.
    """

    def __init__(self) -> None:
        self.value, self.due, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.value, self.due = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.value, self.due = b & 0x0F, 2
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.value, self.due = b & 0x07, 3
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left = "�" if self.due else ""
        self.__init__()
        return left


def decode_stream(ids: Iterable[int], path: str = DEFAULT_PATH) -> Iterator[str]:
    """Text of a stream of ids, as far as each id completes it."""
    pieces, stream = encoder(path).machine.bytes_of, Utf8Stream()
    for i in ids:
        if text := stream.feed(pieces[i]):
            yield text
    if rest := stream.close():
        yield rest


def token_ids(col: Column, path: str = DEFAULT_PATH) -> Column:
    """Column of texts -> array<int> of ids without special tokens; empty for null and empty texts."""
    shared(path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        flat, offs = array("i"), np.zeros(len(texts) + 1, np.int32)
        for i, text in enumerate(texts.to_pylist()):
            flat.extend(enc.encode(text))
            offs[i + 1] = len(flat)
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))

    return ids(col)


def token_count(col: Column, path: str = DEFAULT_PATH) -> Column:
    """Column of texts -> number of tokens; 0 for null and empty texts."""
    shared(path)

    @F.arrow_udf(T.IntegerType())
    def n(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([enc.count(t) for t in texts.to_pylist()], pa.int32())

    return n(col)


def decoded(col: Column, path: str = DEFAULT_PATH) -> Column:
    """Column of ids -> text; null for null."""
    shared(path)

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "".join(decode_stream(x, path)) for x in ids.to_pylist()], pa.string())

    return text(col)


__all__ = ["Encoder", "Transducer", "Utf8Stream", "decode_stream", "decoded", "encoder", "token_count", "token_ids"]
