"""Labels and forests.

A record is a forest: a list of trees, each a pair (label, children).  A label is a pair
(kind, value) with one of six kinds; field names and values are labels alike.
"""

from __future__ import annotations

from typing import Any

Label = tuple[str, Any]
Tree = tuple[Label, list]

BOOL, INT, UINT, DOUBLE, STRING, BYTES = "bool", "int", "uint", "double", "string", "bytes"
KINDS = (BOOL, INT, UINT, DOUBLE, STRING, BYTES)
LISTS = {kind: f"[]{kind}" for kind in KINDS}


def leaf(kind: str, value: Any) -> Tree:
    return (kind, value), []


def node(name: str, children: list[Tree]) -> Tree:
    return (STRING, name), children


def wrap_int(value: int) -> int:
    """Two's complement in 64 bits."""
    return (value + 2**63) % 2**64 - 2**63
