"""Protobuf bytes to forests, led by a FileDescriptorSet.

A field is a node labelled by its name; neighbouring values of a repeated field share a
node and are labelled by their index; messages nest.  Unknown fields are skipped, packed
values unpacked, groups refused.  int, sint and sfixed give int; uint, fixed and enum
uint; float and double double.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

from treegate.labels import BOOL, BYTES, DOUBLE, INT, STRING, UINT, Tree, leaf

VARINT, FIXED64, DELIMITED, START_GROUP, END_GROUP, FIXED32 = range(6)

#: Descriptor type numbers of the public protobuf format, their wire types and names.
DOUBLE_T, FLOAT_T, INT64_T, UINT64_T, INT32_T, FIXED64_T, FIXED32_T, BOOL_T, STRING_T, GROUP_T, MESSAGE_T, BYTES_T, UINT32_T, ENUM_T, SFIXED32_T, SFIXED64_T, SINT32_T, SINT64_T = range(1, 19)
WIRE = {
    DOUBLE_T: FIXED64, FLOAT_T: FIXED32, INT64_T: VARINT, UINT64_T: VARINT, INT32_T: VARINT, FIXED64_T: FIXED64, FIXED32_T: FIXED32, BOOL_T: VARINT, STRING_T: DELIMITED,
    GROUP_T: START_GROUP, MESSAGE_T: DELIMITED, BYTES_T: DELIMITED, UINT32_T: VARINT, ENUM_T: VARINT, SFIXED32_T: FIXED32, SFIXED64_T: FIXED64, SINT32_T: VARINT, SINT64_T: VARINT,
}
REPEATED = 3


class ProtoError(ValueError):
    """Bytes or descriptors that cannot be read."""


# primitives


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned 64-bit number and where the next byte is."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ProtoError("the bytes end inside a number")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & (2**64 - 1), at
        shift += 7
        if shift >= 70:
            raise ProtoError("a number of over ten bytes")


def put_varint(value: int) -> bytes:
    value &= 2**64 - 1
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def word_to_float(word: int) -> float:
    return struct.unpack("<f", struct.pack("<I", word))[0]


def float_to_word(value: float) -> int:
    return struct.unpack("<I", struct.pack("<f", value))[0]


def word_to_double(word: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", word))[0]


def double_to_word(value: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", value))[0]


def zigzag(value: int, bits: int = 64) -> int:
    return (value << 1 ^ value >> bits - 1) & (1 << bits) - 1


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def signed(value: int, bits: int = 64) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> bits - 1 else value


# descriptors


@dataclass
class Field:
    name: str
    number: int
    label: int
    type: int
    type_name: str | None = None
    packed: bool | None = None

    @property
    def is_repeated(self) -> bool:
        return self.label == REPEATED

    @property
    def is_scalar(self) -> bool:
        return self.type not in (GROUP_T, MESSAGE_T)

    @property
    def could_be_packed(self) -> bool:
        return self.is_repeated and self.is_scalar and self.type not in (STRING_T, BYTES_T)

    @property
    def tags(self) -> list[int]:
        """The tag of its wire type, and of the packed form where it could be packed."""
        out = [self.number << 3 | WIRE[self.type]]
        return [*out, self.number << 3 | DELIMITED] if self.could_be_packed else out


@dataclass
class Message:
    name: str
    fields: list[Field] = field(default_factory=list)
    nested: list[Message] = field(default_factory=list)


def wire_from_tag(tag: int) -> int:
    return tag & 7


def _raw_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = get_varint(data, at)
        value, at = _raw_value(data, at, wire_from_tag(tag))
        yield tag >> 3, value


def _message(data: bytes) -> Message:
    out = Message("")
    for number, value in _raw_fields(data):
        if number == 1:
            out.name = value.decode()
        elif number == 2:
            own = {n: v for n, v in _raw_fields(value)}
            options = dict(_raw_fields(own.get(8, b"")))
            out.fields.append(Field(own[1].decode(), own[3], own.get(4, 1), own[5], own[6].decode() if 6 in own else None, bool(options[2]) if 2 in options else None))
        elif number == 3:
            out.nested.append(_message(value))
    return out


def decode_file_descriptor_set(data: bytes) -> list[tuple[str, list[Message]]]:
    """(package, messages) of each file; the format is protobuf's own descriptor.proto."""
    out = []
    for number, value in _raw_fields(data):
        if number == 1:
            package, messages = "", []
            for n, v in _raw_fields(value):
                if n == 2:
                    package = v.decode()
                elif n == 4:
                    messages.append(_message(v))
            out.append((package, messages))
    return out


class Descriptors:
    """Messages and fields by number, in file order, nested messages behind their own."""

    def __init__(self, files: Iterable[tuple[str, list[Message]]]):
        self.messages: list[tuple[str, Message]] = []
        for package, messages in files:
            for m in messages:
                self._list(f".{package}" if package else "", m)
        self.index = {name: i for i, (name, _) in enumerate(self.messages)}
        self.fields: list[Field] = []
        self.tag_to_field: list[dict[int, int]] = []
        self.field_to_message: dict[int, int] = {}
        for _, message in self.messages:
            tags = {}
            for f in message.fields:
                for tag in f.tags:
                    tags[tag] = len(self.fields)
                if f.type == MESSAGE_T:
                    if f.type_name not in self.index:
                        raise ProtoError(f"no message named {f.type_name}")
                    self.field_to_message[len(self.fields)] = self.index[f.type_name]
                self.fields.append(f)
            self.tag_to_field.append(tags)

    def _list(self, prefix: str, message: Message) -> None:
        name = f"{prefix}.{message.name}"
        self.messages.append((name, message))
        for m in message.nested:
            self._list(name, m)

    @classmethod
    def from_bytes(cls, data: bytes) -> Descriptors:
        return cls(decode_file_descriptor_set(data))

    def message(self, name: str) -> int:
        name = name if name.startswith(".") else f".{name}"
        if name not in self.index:
            raise ProtoError(f"no message named {name}")
        return self.index[name]


# records


def _raw_value(data: bytes, at: int, wire: int) -> tuple[int | bytes, int]:
    if wire == VARINT:
        return get_varint(data, at)
    if wire == DELIMITED:
        n, at = get_varint(data, at)
    elif wire in (FIXED64, FIXED32):
        n = 8 if wire == FIXED64 else 4
    else:
        raise ProtoError("group is not supported")
    if at + n > len(data):
        raise ProtoError("the bytes end inside a value")
    part = data[at : at + n]
    return (part if wire == DELIMITED else int.from_bytes(part, "little")), at + n


def _scalar(kind: int, raw: int | bytes) -> Tree:
    match kind:
        case 5:
            return leaf(INT, signed(raw))
        case 3:
            return leaf(INT, signed(raw))
        case 13 | 4 | 14 | 7 | 6:
            return leaf(UINT, raw)
        case 8:
            return leaf(BOOL, raw != 0)
        case 17 | 18:
            return leaf(INT, unzigzag(raw))
        case 15:
            return leaf(INT, signed(raw, 32))
        case 16:
            return leaf(INT, signed(raw))
        case 2:
            return leaf(DOUBLE, word_to_float(raw))
        case 1:
            return leaf(DOUBLE, word_to_double(raw))
        case 12:
            return leaf(BYTES, bytes(raw))
        case 9:
            try:
                return leaf(STRING, raw.decode("utf-8"))
            except UnicodeDecodeError as e:
                raise ProtoError(str(e)) from e
    raise ProtoError("group is not supported")


def _packed(kind: int, data: bytes) -> Iterator[Tree]:
    at = 0
    while at < len(data):
        raw, at = _raw_value(data, at, WIRE[kind])
        yield _scalar(kind, raw)


def _values(d: Descriptors, message: int, data: bytes) -> Iterator[tuple[int, list[Tree]]]:
    """(field, forest) of every known value in wire order."""
    at = 0
    while at < len(data):
        tag, at = get_varint(data, at)
        number = d.tag_to_field[message].get(tag)
        raw, at = _raw_value(data, at, wire_from_tag(tag))
        if number is None:
            continue
        f = d.fields[number]
        if f.type == MESSAGE_T:
            yield number, decode(d, d.field_to_message[number], raw)
        elif f.could_be_packed and wire_from_tag(tag) == DELIMITED:
            for tree in _packed(f.type, raw):
                yield number, [tree]
        else:
            yield number, [_scalar(f.type, raw)]


def merge_repeated(d: Descriptors, values: Iterable[tuple[int, list[Tree]]]) -> list[Tree]:
    """Nodes of fields; a run of one repeated field is one node of indexed values."""
    out: list[Tree] = []
    for number, run in groupby(values, key=lambda v: v[0]):
        name = (STRING, d.fields[number].name)
        if d.fields[number].is_repeated:
            out.append((name, [((INT, i), forest) for i, (_, forest) in enumerate(run)]))
        else:
            out.extend((name, forest) for _, forest in run)
    return out


def decode(d: Descriptors, message: int, data: bytes) -> list[Tree]:
    """The forest of a message's bytes; raises :class:`ProtoError`."""
    return merge_repeated(d, _values(d, message, bytes(data)))


# a small writer, for tests and examples


def encode_field(number: int, kind: int, value) -> bytes:
    tag = put_varint(number << 3 | WIRE[kind])
    if kind in (STRING_T, BYTES_T, MESSAGE_T):
        raw = value.encode() if isinstance(value, str) else value
        return tag + put_varint(len(raw)) + raw
    if kind in (SINT32_T, SINT64_T):
        return tag + put_varint(zigzag(value))
    if WIRE[kind] == VARINT:
        return tag + put_varint(int(value))
    if kind in (DOUBLE_T, FLOAT_T):
        return tag + struct.pack("<d" if kind == DOUBLE_T else "<f", value)
    return tag + (value & (2**64 - 1)).to_bytes(8, "little") if WIRE[kind] == FIXED64 else tag + (value & (2**32 - 1)).to_bytes(4, "little")
