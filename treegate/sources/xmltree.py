"""XML text to forests.

An element is a node labelled by its local name; text and CDATA are leaves, blank ones
too.  A label that reads as an integer is an int, names included.  Attributes, comments,
processing instructions and the prolog give no node.
"""

from __future__ import annotations

import re
from xml.parsers import expat

from treegate.labels import INT, STRING, Label, Tree, wrap_int

_INTEGER = re.compile(r"\s*(?:(-?)\s*(\d+|0[xX][0-9a-fA-F]+|0[oO][0-7]+))\s*")


class XmlError(ValueError):
    """Text that isn't well-formed XML."""


def label(text: str) -> Label:
    bare = text.strip()
    while bare.startswith("(") and bare.endswith(")"):
        bare = bare[1:-1].strip()
    found = _INTEGER.fullmatch(bare) if bare else None
    if not found:
        return STRING, text
    sign, digits = found.groups()
    value = int(digits, 0) if digits[:2].lower() in ("0x", "0o") else int(digits)
    return INT, wrap_int(-value if sign else value)


def decode(text: str | bytes) -> list[Tree]:
    """The forest of one document; raises :class:`XmlError`."""
    out: list[Tree] = []
    stack = [out]
    held: list[str] = []

    def flush() -> None:
        if held:
            stack[-1].append((label("".join(held)), []))
            held.clear()

    def start(name: str, _attributes: dict) -> None:
        flush()
        children: list[Tree] = []
        stack[-1].append((label(name.rpartition(":")[2]), children))
        stack.append(children)

    def end(_name: str) -> None:
        flush()
        stack.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = held.append
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = flush
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, ValueError) as e:
        raise XmlError(str(e)) from e
    return out
