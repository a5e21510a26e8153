"""Batch encoding with the tokenizers library, each distinct word piece once.

A pre-tokenizer cuts a text into pieces whose ids do not depend on their neighbours.
Where the tokenizer file has one of the two known cutting rules, and the text stays
within U+0000-U+024F, the same rule runs here as a compiled expression, and the
library encodes only pieces that this worker has not met; every other text, and every
text that holds the content of an added token (which the library takes as that token),
goes to the library whole. Both ways give the same ids (tests compare them).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

#: Pieces kept by a worker unless asked otherwise (about 100 MB), and the longest piece kept.
CACHE_PIECES, CACHE_CHARS = 500_000, 64

#: Bytes of text encoded together.
ENCODE_BYTES = 1_000_000

#: The cutting expressions of the two known tokenizer files.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normalising steps of the second, which cut text the same way as blanks stand as they are.
WORD_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _ranges(has) -> str:
    out, start = [], None
    for c in range(0x251):
        if c < 0x250 and has(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


_L = _ranges(lambda c: unicodedata.category(c)[0] == "L")
_N = _ranges(lambda c: unicodedata.category(c)[0] == "N")
_S = r"\t-\r \u0085 "
#: Characters that leave the fast way; where texts are lower-cased, those too whose lower case is outside or longer.
_OTHER = re.compile("[^\\u0000-\\u024f]")
_OTHER_CASED = re.compile(f"[^{_ranges(lambda c: len(c.lower()) == 1 and ord(c.lower()) < 0x250)}]")


def _compiled(rule: str) -> re.Pattern:
    rule = rule.replace("[\\p{L}]", f"[{_L}]").replace("[\\p{N}]", f"[{_N}]").replace("[^\\s\\p{L}\\p{N}]", f"[^{_S}{_L}{_N}]")
    return re.compile(rule.replace("\\p{L}", f"[{_L}]").replace("\\p{N}", f"[{_N}]").replace("(?!\\S)", f"(?![^{_S}])").replace("\\s+", f"[{_S}]+"))


class _Pieces(dict):
    """Ids of pieces met lately; one that is asked for and unknown moves over from ``old`` or is encoded."""

    def __init__(self, encode, old: dict[str, bytes]):
        super().__init__()
        self.encode, self.old = encode, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # once the younger half is full it becomes the older one, whose pieces stay if they are met again
        self.half = pieces // 2
        self.young = _Pieces(self._piece, {})
        self.find, self.lower = None, False
        #: what the library may take as an added token, wherever it stands
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if spec.get("post_processor") or spec.get("truncation") or spec.get("padding"):
            return
        if any(x.get("normalized") or not x["content"] for x in spec.get("added_tokens") or []):
            return  # these are looked for in the normalised text
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.find = _compiled(BYTE_LEVEL).findall
        elif norm and pre.get("type") == "Sequence":
            steps, cuts = norm.get("normalizers", []), pre["pretokenizers"]
            if steps == WORD_STEPS and len(cuts) == 2 and cuts[0].get("pattern", {}).get("Regex") == WORD_LEVEL and cuts[0].get("invert") and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"]:
                self.find, self.lower = _compiled(WORD_LEVEL).findall, True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.find is None:
            return self._library(texts)
        out: list[bytes | None] = [None] * len(texts)
        slow, other = [], (_OTHER_CASED if self.lower else _OTHER).search
        for i, text in enumerate(texts):
            low = text.lower() if self.lower else text
            if any(x in text or x in low for x in self.added):
                slow.append(i)
            elif text.isascii() or not other(text):
                if len(self.young) > self.half:
                    self.young.old = {}
                    self.young = _Pieces(self._piece, dict(self.young))
                out[i] = b"".join(map(self.young.__getitem__, self.find(low)))
            else:
                slow.append(i)
        if slow:
            for i, ids in zip(slow, self._library([texts[i] for i in slow]), strict=True):
                out[i] = ids
        return out


encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, pieces: int = CACHE_PIECES) -> Encoder:
    """This worker's encoder of a tokenizer file with a cache of this size."""
    if (path, pieces) not in encoders:
        encoders.clear()  # one at a time: caches are large
        encoders[path, pieces] = Encoder(path, pieces)
    return encoders[path, pieces]
