"""Problem 10: texts over a token limit cut into pieces at natural boundaries, with a fixed overlap.

Token offsets are prefix sums over the encoded text; headings, paragraphs, lines, sentences and words give sorted arrays
of boundaries, kept where a token ends. A piece ends at the last boundary of the strongest kind within the limit (binary
search; kinds above words only in the last half of the piece), else at the last token that ends a character. The next
piece begins ``overlap`` tokens before that end, earlier by the few tokens it takes to begin at a character. Pieces are
contiguous substrings whose own encoding has just the tokens counted. Texts within the limit, empty and null ones give
no piece.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import codepoints as cp
from millrace.llm.bpe import DEFAULT_PATH, encoder, shared

KINDS = ("heading", "paragraph", "line", "sentence", "word")
_MARK = re.compile(r"#{1,6}[ \t]|[=\-*_]{3,}[^\S\n]*(?:\n|$)")  # a line that is a heading or a rule
FIELDS = "id bigint, profile string, piece_no int, start_char bigint, end_char bigint, n_tokens int, ends_at string, piece string"


def _flags(chars: str, *ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    for a, b in ranges:
        out[a : b + 1] = True
    return out


SPACE = _flags("".join(chr(c) for c in range(0x3001) if chr(c).isspace()))
STOP, WIDE_STOP = _flags(".!?؟。！？…"), _flags("。！？")
CLOSE, WIDE_CLOSE = _flags("\"'”’»)]"), _flags("”’」』")
UNSPACED = _flags("", (0x3040, 0x30FF), (0x3400, 0x9FFF))
UNSPACED_END = UNSPACED | _flags("，；、")
HEAD = _flags("#=-*_")


def _next_without(flag: np.ndarray) -> np.ndarray:
    """For each position the first one at or after it that does not have the flag."""
    n = len(flag)
    at = np.where(flag, n, np.arange(n))
    return np.minimum.accumulate(at[::-1])[::-1]


def _places(cps: np.ndarray, texts: list[str], begin: np.ndarray) -> list[np.ndarray]:
    """Positions of each kind of boundary in texts that lie in ``cps`` one after the other, a 0 after each. All but sentence
    ends come before the white space there, so that the parts encode as they do in the whole."""
    space, line = SPACE[cps], cps == 10
    fresh = space.copy()
    fresh[1:] &= ~space[:-1]
    run_start = np.flatnonzero(fresh)  # of each run of white space
    run = np.cumsum(fresh) - 1
    if len(run_start):
        breaks = np.bincount(run[line], minlength=len(run_start)) if line.any() else np.zeros(len(run_start), np.int64)
        after = _next_without(space)[run_start]  # the position after the run; texts end with a 0
        paragraph = run_start[breaks > 1]
        marked = np.flatnonzero(line[after - 1] & HEAD[cps[after]])
        row = np.searchsorted(begin, after[marked], "right") - 1
        ok = [_MARK.match(texts[r], int(x)) is not None for r, x in zip(row, after[marked] - begin[row])]
        heading = run_start[marked[np.array(ok, bool)]] if len(marked) else marked
        at = np.flatnonzero(line)
        plain = np.where(space & ~line, -1, np.arange(len(cps)))
        before = np.maximum.accumulate(plain)  # the last position that is no blank
        lines = np.where(at > 0, before[at - 1] + 1, 0)
    else:
        heading = paragraph = lines = np.zeros(0, np.int64)
    stop = np.flatnonzero(STOP[cps])
    end = _next_without(CLOSE[cps])[stop + 1]
    wide = WIDE_STOP[cps[stop]] & ~space[end]  # ends a sentence whatever follows
    sentence = np.union1d(end[space[end]], _next_without(WIDE_CLOSE[cps])[stop[wide] + 1])
    loose = np.flatnonzero(UNSPACED_END[cps[:-1]] & UNSPACED[cps[1:]]) + 1
    word = np.union1d(run_start, loose)
    return [heading, paragraph, np.unique(lines), sentence, word]


class Offsets:
    """Tokens of a text with the characters they end at (-1 where a token ends inside one), and the token numbers of each
    kind of boundary, ascending."""

    def __init__(self, text: str, path: str = DEFAULT_PATH):
        self.__dict__ = offsets_of([text], path)[0].__dict__

    @classmethod
    def of(cls, text: str, char: np.ndarray, bounds: list[np.ndarray]) -> Offsets:
        new = cls.__new__(cls)
        new.text, new.n, new.char, new.bounds = text, len(char) - 1, char, bounds
        new.whole = np.flatnonzero(char[1:] >= 0) + 1  # tokens after which a character is complete
        return new


def offsets_of(texts: list[str], path: str = DEFAULT_PATH, least: int = 0) -> list[Offsets]:
    """The offsets of those texts that have more than ``least`` tokens; prefix sums and boundaries are made once for all."""
    enc = encoder(path)
    live, ids, tokens = [], array("i"), [0]
    for text in texts:
        if len(text) * 4 > least:  # a token has at least one byte
            own = enc.encode(text)
            if len(own) > least:
                live.append(text)
                ids.extend(own)
                tokens.append(len(ids))
    if not live:
        return []
    cps, offs = cp.from_texts(live)
    rows = np.arange(len(live))
    begin = offs[:-1] + rows  # with a 0 after each text
    spread = np.zeros(len(cps) + len(live), np.uint32)
    spread[np.arange(len(cps)) + np.repeat(rows, np.diff(offs))] = cps
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    char_bytes = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(enc.widths[np.frombuffer(ids, np.int32)])
    at = np.searchsorted(char_bytes, ends)
    exact = char_bytes[np.minimum(at, len(cps))] == ends
    row = np.repeat(rows, np.diff(tokens))
    inside = at - offs[row]
    number = np.arange(len(ids)) - np.array(tokens)[row] + 1
    token_at = np.zeros(len(spread), np.int64)
    token_at[(begin[row] + inside)[exact]] = number[exact]
    kinds = []
    for places in _places(spread, live, begin):
        hit = token_at[places]
        kinds.append((hit[hit > 0], np.searchsorted(places[hit > 0], begin).tolist() + [int((hit > 0).sum())]))
    char = np.where(exact, inside, -1)
    return [Offsets.of(t, np.concatenate([[0], char[tokens[i] : tokens[i + 1]]]), [h[x[i] : x[i + 1]] for h, x in kinds]) for i, t in enumerate(live)]


def cuts(off: Offsets, max_tokens: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first token, token after the last, kind of boundary it ends at) of each piece."""
    checked(max_tokens, overlap)
    out, start, done = [], 0, 0
    while off.n - start > max_tokens:
        limit = start + max_tokens
        least = max(done, start + overlap + 3)  # each piece goes beyond the one before; a character has four tokens at most
        end, kind = -1, "hard"
        for name, places in zip(KINDS, off.bounds):
            floor = least if name == "word" else max(least, start + max_tokens // 2)
            at = int(np.searchsorted(places, limit, "right")) - 1
            if at >= 0 and places[at] > floor:
                end, kind = int(places[at]), name
                break
        if end < 0:
            end = int(off.whole[np.searchsorted(off.whole, limit, "right") - 1])
            if end <= least:
                raise ValueError("no character ends within the limit")
        out.append((start, end, kind))
        done = end
        start = _begin(off, max(start, end - max_tokens + 8), end - overlap) if overlap else end
    out.append((start, off.n, "end"))
    return out


def checked(max_tokens: int, overlap: int) -> None:
    """A character may take four tokens, so a piece needs some tokens beside its overlap to go on."""
    if max_tokens < 16 or not 0 <= overlap <= max_tokens - 12:
        raise ValueError("a limit of at least 16 tokens and an overlap of at least 12 tokens less are needed")


def _begin(off: Offsets, start: int, at: int) -> int:
    """The token at or before ``at`` that begins a character; not an apostrophe, which would part differently there, if
    there is another after ``start``."""
    while off.char[at] < 0:
        at -= 1
    back = at
    while back > start and (off.char[back] < 0 or off.text[off.char[back]] in "'’"):
        back -= 1
    return back if back > start else at


def _numbered(some: list[int], texts: list[str], path: str, least: int):
    """(position, offsets) of those of ``some`` texts that have more than ``least`` tokens."""
    made = offsets_of([texts[i] for i in some], path, least)
    at = 0
    for i in some:  # those left out are passed over; the others come in order
        if at < len(made) and made[at].text is texts[i]:
            yield i, made[at]
            at += 1


def split_texts(df: DataFrame, id_col: str, text_col: str, profiles: list[tuple[str, int, int]], path: str = DEFAULT_PATH) -> DataFrame:
    """Pieces of every text over the limit of a profile (name, max_tokens, overlap_tokens)."""

    shared(path)
    for _, most, overlap in profiles:
        checked(most, overlap)

    def split(batches):
        least = min((m for _, m, _ in profiles), default=0)
        for batch in batches:
            for lo, hi in cp.slices(batch.column(1)):
                keys, texts = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
                some = [i for i, t in enumerate(texts) if t and len(t) * 4 > least]
                rows: list[tuple] = []
                for i, off in _numbered(some, texts, path, least):
                    for name, most, overlap in profiles:
                        if off.n > most:
                            for k, (a, b, kind) in enumerate(cuts(off, most, overlap)):
                                x, y = int(off.char[a]), int(off.char[b])
                                rows.append((keys[i], name, k, x, y, b - a, kind, off.text[x:y]))
                    if len(rows) >= 4000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(split, FIELDS)
    return out.withColumnRenamed("id", id_col)


def profiles_of(limits: DataFrame) -> list[tuple[str, int, int]]:
    """The profiles of a table (profile, max_tokens, overlap_tokens) of at most 1,000 rows."""
    rows = limits.select("profile", "max_tokens", "overlap_tokens").where("profile IS NOT NULL AND max_tokens IS NOT NULL").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("split limits must be at most 1,000 rows")
    return sorted((r[0], int(r[1]), int(r[2] or 0)) for r in rows)
