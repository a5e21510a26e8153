"""POSIX extended regular expressions, rewritten for Python and Java.

The dialect: alternation, groups, ``* + ? {m,n}``, bracket expressions with classes, and
a backslash that makes the next sign literal.  ``^`` and ``$`` hold at line breaks too,
and neither ``.`` nor a negated bracket takes a line break.  Only whether a match exists
counts, so leftmost-longest and leftmost-first matching agree.
"""

from __future__ import annotations

import functools
import re

from treegate.errors import GrammarError

#: Bracket classes over ASCII.
CLASSES = {
    "alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": "\\x09-\\x0d\\x20", "blank": "\\x09\\x20",
    "punct": "\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e", "print": "\\x20-\\x7e", "graph": "\\x21-\\x7e", "cntrl": "\\x00-\\x1f\\x7f", "xdigit": "0-9a-fA-F", "word": "a-zA-Z0-9_",
}

_ASSERTIONS = {"`": r"\A", "'": r"(?![\s\S])", "b": r"\b", "B": r"\B", "<": r"\b(?=\w)", ">": r"\b(?<=\w)"}


def _sign(c: str) -> str:
    if c.isalnum() or c == "_" or (ord(c) > 126 and ord(c) < 0x10000 and c.isprintable()):
        return c
    return f"\\x{ord(c):02x}" if ord(c) < 256 else c


def _bracket(text: str, i: int) -> tuple[str, int]:
    negated = text[i : i + 1] == "^"
    i += negated
    parts, first = [], True
    while True:
        if i >= len(text):
            raise GrammarError(f"regex: bracket without end in {text!r}")
        c = text[i]
        if c == "]" and not first:
            break
        first = False
        if text.startswith("[:", i):
            end = text.find(":]", i)
            name = text[i + 2 : end]
            if end < 0 or name not in CLASSES:
                raise GrammarError(f"regex: unknown class in {text!r}")
            parts.append(CLASSES[name])
            i = end + 2
            continue
        if text[i : i + 2] in ("[=", "[."):
            raise GrammarError(f"regex: collating elements are not supported: {text!r}")
        if text[i + 1 : i + 2] == "-" and text[i + 2 : i + 3] not in ("]", ""):
            low, high = c, text[i + 2]
            if low > high:
                raise GrammarError(f"regex: empty range in {text!r}")
            parts.append(f"{_sign(low)}-{_sign(high)}")
            i += 3
            continue
        parts.append(_sign(c))
        i += 1
    return f"[{'^' if negated else ''}{''.join(parts)}{chr(92) + 'n' if negated else ''}]", i + 1


@functools.lru_cache(maxsize=4096)
def translate(text: str) -> str:
    """The same language as a pattern that Python's ``re`` and Java both read alike."""
    out: list[str] = []
    i, depth, item = 0, 0, False  # item: something that a quantifier may follow
    while i < len(text):
        c = text[i]
        i += 1
        if c == "\\":
            if i >= len(text):
                raise GrammarError(f"regex: trailing backslash in {text!r}")
            d = text[i]
            i += 1
            out.append(_ASSERTIONS.get(d) or _sign(d))
            item = d not in _ASSERTIONS
        elif c == "[":
            part, i = _bracket(text, i)
            out.append(part)
            item = True
        elif c == "(":
            depth += 1
            out.append("(?:")
            item = False
        elif c == ")" and depth:
            depth -= 1
            out.append(")")
            item = True
        elif c in "*+?" or (c == "{" and re.match(r"\d+(,\d*)?\}", text[i:])):
            if not item:
                raise GrammarError(f"regex: nothing to repeat in {text!r}")
            if c == "{":
                end = text.index("}", i) + 1
                c, i = "{" + text[i:end], end
            if out[-1].startswith("{") or out[-1] in "*+?":
                # a second quantifier repeats the repeated: Python and Java read it differently
                start = _atom_start(out)
                out[start:] = ["(?:" + "".join(out[start:]) + ")"]
            out.append(c)
        elif c == "|":
            out.append("|")
            item = False
        elif c == "^":
            out.append(r"(?:(?<=\n)|\A)")
            item = False
        elif c == "$":
            out.append(r"(?![^\n])")
            item = False
        elif c == ".":
            out.append(r"[^\n]")
            item = True
        else:
            out.append(_sign(c))
            item = True
    if depth:
        raise GrammarError(f"regex: group without end in {text!r}")
    done = "".join(out)
    try:
        re.compile(done)
    except re.error as e:
        raise GrammarError(f"regex {text!r}: {e}") from e
    return done


def _atom_start(out: list[str]) -> int:
    """Where the last repeated atom begins in the parts so far."""
    i = len(out) - 1
    while out[i].startswith("{") or out[i] in "*+?":
        i -= 1
    if out[i] != ")":
        return i
    depth = 0
    while True:
        depth += (out[i] == ")") - (out[i] == "(?:")
        if depth == 0:
            return i
        i -= 1


@functools.lru_cache(maxsize=4096)
def compiled(text: str) -> re.Pattern:
    return re.compile(translate(text))


def matches(pattern: str, subject: str) -> bool:
    """Whether the pattern matches anywhere in the subject."""
    return compiled(pattern).search(subject) is not None
