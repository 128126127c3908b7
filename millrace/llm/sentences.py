"""Sentence boundaries in flat code-point texts, for all rows at once."""

from __future__ import annotations

import numpy as np

from millrace.llm.codepoints import UNSPACED


def _set(chars: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


STOP = _set(".!?。！？؟…．｡۔")
WIDE_STOP = _set("。！？｡")
CLOSE = _set("\"'”’»)]」』）＇＂›")
SPACE = _set("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
BREAK = _set("\n\r\u2028\u2029")


def sentence_offsets(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of sentences with the end of all last, first sentence of each row with their number last).

    A sentence ends with a line break, or with a stop (and closing marks) before white space or a character of a script
    without spaces; a wide stop ends one whatever follows. The sentences of a row cover it; an empty row has none.
    """
    n = len(cps)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    stop, close = STOP[cps], CLOSE[cps]
    ended = stop.copy()
    for _ in range(3):
        ended[1:] |= close[1:] & ended[:-1]
    nxt = np.append(cps[1:], 10)
    last = ended & (SPACE[nxt] | UNSPACED[nxt])
    wide = WIDE_STOP[cps].copy()
    for _ in range(2):
        wide[1:] |= close[1:] & wide[:-1]
    last |= wide & ~CLOSE[nxt] & ~STOP[nxt]
    last |= BREAK[cps]
    begin = np.zeros(n + 1, bool)
    begin[1:] = last
    begin[offs[:-1]] = True
    begin[n] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offs)
