"""Statistics of whole texts, computed for all rows of a slice at once."""

from __future__ import annotations

import numpy as np

from treegate.llm import kernels as K

#: The signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_letters", "n_distinct", "n_stops"]

_SYMBOL, _UPPER, _DIGIT, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?.,;:")] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False  # continuation bytes start no code point


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def counts(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The columns of ``COUNTS`` per row; and per word its hash and row.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. word_chars: code points in words.
    n_dup_lines: lines (cut at \\n) with a word that equal an earlier line.
    n_repeat_words: words inside a five-word window that occurs twice or more in the
    text, its first occurrence included.
    """
    n = len(offs) - 1
    starts, ends, first = K.word_bounds(buf, offs)
    words = K.span_hashes(buf, starts, ends)
    row = np.repeat(np.arange(n), np.diff(first))
    salt = K.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_row(_HEAD[buf] & ~K.SPACE[buf], offs)
    out["n_symbols"] = _per_row(_SYMBOL[buf], offs)

    # lines: cut at \n and at row ends
    cut = np.flatnonzero(buf == 0x0A)
    line_start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cut + 1])) if len(buf) else np.zeros(0, np.int64)
    line_start = line_start[line_start < len(buf)]
    line_row = np.searchsorted(offs, line_start, side="right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(buf)), offs[line_row + 1]) if len(line_start) else line_start
    line_end = line_end - ((line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 0x0A)) if len(line_start) else line_end
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row, lines = line_row[filled], K.span_hashes(buf, line_start[filled], line_end[filled])
    _, at = np.unique(K.mix(lines ^ salt[line_row]), return_index=True)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[at], minlength=n)

    # five-word windows
    repeat = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        windows = K.shingle_hashes(words, WINDOW)
        whole = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :])
        _, inverse, seen = np.unique(K.mix(windows[whole] ^ salt[row[whole]]), return_inverse=True, return_counts=True)
        twice = whole[seen[inverse] > 1]
        np.add.at(repeat, twice, 1)
        np.add.at(repeat, twice + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row, weights=np.cumsum(repeat)[:-1] > 0, minlength=n).astype(np.int64)

    _, at = np.unique(K.mix(words ^ salt[row]), return_index=True)
    out["n_distinct"] = np.bincount(row[at], minlength=n)
    out["n_stops"] = np.bincount(row, weights=(ends - starts) <= 3, minlength=n).astype(np.int64)
    for name, table in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_letters", _LETTER)):
        out[name] = _per_row(table[buf], offs)
    return out, words, row
