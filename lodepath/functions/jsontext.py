"""JSON as text: strict parsing that keeps how numbers are written, canonical forms and types.

Used inside mapInArrow; nothing here touches Spark. Depth has no limit: the fast, recursive ways hand over to
iterative ones with the same results where Python's own limit is met.
"""

from __future__ import annotations

import hashlib
import json
import re
from json.decoder import scanstring


class Number:
    """A JSON number that keeps its literal text."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other):
        return isinstance(other, Number) and other.text == self.text

    def __hash__(self):
        return hash(self.text)

    def __repr__(self):
        return f"Number({self.text})"


def _no_constant(x: str):
    raise ValueError(f"not JSON: {x}")


_plain = json.JSONDecoder(parse_constant=_no_constant)
_exact = json.JSONDecoder(parse_constant=_no_constant, parse_float=Number, parse_int=Number)
_pairs = json.JSONDecoder(parse_constant=_no_constant, parse_float=Number, parse_int=Number, object_pairs_hook=lambda p: Pairs(p))


class Pairs(list):
    """An object as its members in order; repeated names are kept."""


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _plain_number(m: re.Match):
    return float(m[0]) if m[1] or m[2] else int(m[0])


def decode_deep(text: str, number=lambda m: Number(m[0]), make=dict):
    """The JSON value of text, whatever its depth; ValueError if it is not complete JSON.

    number: what becomes of a number's match; make: what becomes of an object's list of members.
    """
    blank = _BLANK.match

    def bad(at: int):
        raise ValueError(f"not JSON at {at}")

    def name_at(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            bad(at)
        name, at = scanstring(text, at + 1, True)
        at = blank(text, at).end()
        if text[at : at + 1] != ":":
            bad(at)
        return name, blank(text, at + 1).end()

    open_: list[tuple[list, bool]] = []  # members so far, and whether of an object
    names: list[str] = []
    at = blank(text, 0).end()
    while True:
        c = text[at : at + 1]
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in "[{" and c:
            at = blank(text, at + 1).end()
            if text[at : at + 1] == ("]" if c == "[" else "}"):
                value, at = [] if c == "[" else make([]), at + 1
            else:
                open_.append(([], c == "{"))
                if c == "{":
                    name, at = name_at(at)
                    names.append(name)
                continue
        elif c in _WORDS:
            word, value = _WORDS[c]
            if not text.startswith(word, at):
                bad(at)
            at += len(word)
        else:
            m = _NUMBER.match(text, at)
            if not m:
                bad(at)
            value, at = number(m), m.end()
        while True:  # value is whole: it goes to what is open, which may be whole then as well
            at = blank(text, at).end()
            if not open_:
                if at != len(text):
                    bad(at)
                return value
            members, is_object = open_[-1]
            members.append((names.pop(), value) if is_object else value)
            c = text[at : at + 1]
            at = blank(text, at + 1).end()
            if c == ",":
                if is_object:
                    name, at = name_at(at)
                    names.append(name)
                break
            if c != ("}" if is_object else "]"):
                bad(at)
            open_.pop()
            value = make(members) if is_object else members


def parse(text: str):
    """The JSON value of text; ValueError if it is not complete JSON. A repeated name: the last counts."""
    try:
        return _plain.decode(text)
    except RecursionError:
        return decode_deep(text, _plain_number)


def parse_exact(text: str):
    """As parse(), but numbers keep their text."""
    try:
        return _exact.decode(text)
    except RecursionError:
        return decode_deep(text)


def _written(value, number) -> str:
    """Text of a value, members sorted by name (repeated ones in their order), numbers as number() writes them."""
    if isinstance(value, Pairs):
        return "{" + ",".join([f"{json.dumps(k)}:{_written(v, number)}" for k, v in sorted(value, key=lambda p: p[0])]) + "}"
    if isinstance(value, dict):
        return "{" + ",".join([f"{json.dumps(k)}:{_written(value[k], number)}" for k in sorted(value)]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([_written(x, number) for x in value]) + "]"
    return number(value) if isinstance(value, Number) else json.dumps(value)


def _written_deep(value, number) -> str:
    """As _written(), with a stack of its own."""
    out, todo = [], [value]  # a tuple on the stack holds text that is put out as it is
    while todo:
        v = todo.pop()
        if type(v) is tuple:
            out.append(v[0])
        elif isinstance(v, Pairs | dict):
            members = sorted(v, key=lambda p: p[0]) if isinstance(v, Pairs) else [(k, v[k]) for k in sorted(v)]
            out.append("{")
            todo.append(("}",))
            for i in range(len(members) - 1, -1, -1):
                todo += [members[i][1], (("," if i else "") + json.dumps(members[i][0]) + ":",)]
        elif isinstance(v, list):
            out.append("[")
            todo.append(("]",))
            for i in range(len(v) - 1, -1, -1):
                todo.append(v[i])
                if i:
                    todo.append((",",))
        else:
            out.append(number(v) if isinstance(v, Number) else json.dumps(v))
    return "".join(out)


def _as_written(value: Number) -> str:
    return value.text


def canonical(value) -> str:
    """Text that is equal for values that differ in member order, spacing and escapes only."""
    try:
        return _written(value, _as_written)
    except RecursionError:
        return _written_deep(value, _as_written)


def record_digest(data: bytes | str) -> bytes | None:
    """Digest of a complete JSON object's value, None if data is no such object."""
    try:
        if isinstance(data, bytes):
            data = data.decode(json.detect_encoding(data))
        try:
            value = _pairs.decode(data)
        except RecursionError:
            value = decode_deep(data, make=Pairs)
    except ValueError:
        return None
    return hashlib.blake2b(canonical(value).encode(), digest_size=16).digest() if isinstance(value, Pairs) else None


def _same_number(number: Number) -> str:
    """Numbers of one type that are equal get equal text: 1e2 as 100.0; an integer is of another type than a number with fraction or exponent."""
    text = number.text
    if any(c in ".eE" for c in text):
        return repr(float(text))
    return "0" if text == "-0" else text


def comparable(value) -> str:
    """As canonical(), but numbers of one type count by value."""
    try:
        return _written(value, _same_number)
    except RecursionError:
        return _written_deep(value, _same_number)


def types(value) -> set[str]:
    """Names of the raw types in a value parsed by parse_exact(); empty for null and empty arrays."""
    out, todo = set(), [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if isinstance(v, list):
            todo += [(x, depth + 1) for x in v]
        elif v is not None:
            kind = "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "object"
            if isinstance(v, Number):
                kind = "float" if any(c in ".eE" for c in v.text) else "integer"
            out.add("array of " * depth + kind)
    return out


def unwrap(value):
    """What a text that holds JSON array or object text holds; any other value itself."""
    while isinstance(value, str):
        head = value.lstrip(" \t\r\n")[:1]
        if head not in ("[", "{"):
            return value
        try:
            inner = parse_exact(value)
        except ValueError:
            return value
        value = inner
    return value
