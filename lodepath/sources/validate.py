"""Strict reading of one input document: typed, with errors as text, and its flattening to the 33 columns.

Known fields must have exactly their declared kind, must not be repeated, and nothing may follow the
document; unknown fields are accepted. The columns of blobs are serialised with fixed order and number text.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from datetime import datetime
from decimal import Decimal

from ..schema import ENRICHED, JOB, JOB_INFORMATION, PROCESSED, fields

_DATE = re.compile(r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?\s*(?:([Zz])|([+-])(\d{2}):?(\d{2}))$")


class Invalid(ValueError):
    """The document does not follow the contract."""


def decode_gzipped(data: bytes | None) -> bytes:
    """The first member of a gzip file, whole; Invalid with the prefix gunzip: otherwise."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data or b"") + z.flush()
    except zlib.error as e:
        raise Invalid(f"gunzip: {e}") from e
    if not z.eof:
        raise Invalid("gunzip: unexpected end of file")
    return out


class _Object(dict):
    """An object that remembers which names were repeated."""

    repeated: frozenset[str] = frozenset()


def _object(pairs):
    out = _Object(pairs)
    if len(out) != len(pairs):
        names = [k for k, _ in pairs]
        out.repeated = frozenset(n for n in out if names.count(n) > 1)
    return out


def _constant(x):
    raise Invalid(f"expected value, found {x}")


_decoder = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_constant)
_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _kind_of(v) -> str:
    return {str: "string", bool: "boolean", int: "number", float: "number", list: "sequence", _Object: "map"}.get(type(v), "null")


def _wrong(name: str, v, want: str) -> Invalid:
    return Invalid(f"invalid type: {_kind_of(v)} for field `{name}`, expected {want}")


def _whole(v) -> bool:
    """A number written without fraction and exponent, in 64 bits."""
    return type(v) is int and -(2**63) <= v < 2**63


def date_parts(text: str):
    """(date-time without zone, nanoseconds, offset in minutes) of an RFC 3339 text, or None."""
    m = _DATE.match(text)
    if not m:
        return None
    fraction = ((m[7] or "") + "0" * 9)[:9]
    offset = 0 if m[8] else (int(m[10]) * 60 + int(m[11])) * (-1 if m[9] == "-" else 1)
    second = int(m[6])
    try:
        at = datetime(*(int(m[i]) for i in (1, 2, 3, 4, 5)), min(second, 59))
    except ValueError:
        return None
    if second > 60 or abs(offset) >= 1440:
        return None
    return at, second, fraction, offset


def render_date(text: str, short_utc: bool) -> str:
    """RFC 3339 with 0, 3, 6 or 9 digits of fraction; UTC as Z or as +00:00."""
    at, second, fraction, offset = date_parts(text)
    digits = next(n for n in (0, 3, 6, 9) if not fraction[n:].strip("0"))
    tail = "Z" if short_utc and offset == 0 else f"{'-' if offset < 0 else '+'}{abs(offset) // 60:02d}:{abs(offset) % 60:02d}"
    return f"{at:%Y-%m-%dT%H:%M}:{second:02d}" + (f".{fraction[:digits]}" if digits else "") + tail


def _value(name: str, kind: str, v):
    low = kind.lower()
    if v is None:
        if kind.isupper():
            raise _wrong(name, v, {"S": "a string", "B": "a boolean", "U": "a string or whole number"}[kind])
        return [] if low == "l" else None
    if low == "s":
        if not isinstance(v, str):
            raise _wrong(name, v, "a string")
    elif low == "n":
        if type(v) not in (int, float):
            raise _wrong(name, v, "a number")
        try:
            v = float(v)
        except OverflowError:
            v = math.inf
        if math.isinf(v):
            raise Invalid(f"number out of range for field `{name}`")
    elif low == "i":
        if not _whole(v):
            raise _wrong(name, v, "a whole number")
    elif low == "b":
        if not isinstance(v, bool):
            raise _wrong(name, v, "a boolean")
    elif low == "l":
        if not isinstance(v, list):
            raise _wrong(name, v, "a sequence")
        for x in v:
            if not isinstance(x, str):
                raise _wrong(name, x, "a string")
    elif low == "d":
        if not isinstance(v, str):
            raise _wrong(name, v, "a date-time")
        if date_parts(v) is None:
            raise Invalid(f"invalid date-time for field `{name}`")
    elif low == "u":
        if isinstance(v, str):
            return v
        if not _whole(v):
            raise _wrong(name, v, "a string or whole number")
        return str(v)
    return v


def _record(owner, spec: list[tuple[str, str]], where: str) -> dict:
    if not isinstance(owner, _Object):
        raise _wrong(where, owner, "an object")
    out, get, repeated = {}, owner.get, owner.repeated
    for name, kind in spec:
        v = get(name)
        if repeated and name in repeated:
            raise Invalid(f"duplicate field `{name}`")
        if v is None:
            if kind.isupper() and name not in owner:
                raise Invalid(f"missing field `{name}`")
        elif kind in "sS" and type(v) is str or kind in "bB" and type(v) is bool:
            out[name] = v
            continue
        elif kind == "n" and type(v) is float and v == v and abs(v) != math.inf:
            out[name] = v
            continue
        out[name] = _value(name, kind, v)
    return out


_INFO, _V5, _EC, _JOB = fields(JOB_INFORMATION), fields(PROCESSED), fields(ENRICHED), fields(JOB)


def _member(owner: _Object, name: str):
    if name in owner.repeated:
        raise Invalid(f"duplicate field `{name}`")
    if name not in owner:
        raise Invalid(f"missing field `{name}`")
    return owner[name]


def number_text(x: float) -> str:
    """The shortest text of a double: positional from 1e-5 to below 1e16, 1e16 and 1.5e-7 beyond."""
    sign, digits, power = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    power += len(digits) - len("".join(map(str, digits)).rstrip("0") or "0")
    if text == "0":
        return "-0.0" if str(x).startswith("-") else "0.0"
    point = len(text) + power
    if power >= 0 and point <= 16:
        out = text + "0" * power + ".0"
    elif 0 < point <= 16:
        out = f"{text[:point]}.{text[point:]}"
    elif -5 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{point - 1}"
    return ("-" if sign else "") + out


def _odd(v) -> bool:
    """Whether a double's text differs from Python's."""
    return type(v) is float and v != 0 and not 1e-4 <= abs(v) < 1e16


def _blob(values: dict, spec: list[tuple[str, str]], skip: str = "") -> str:
    out = {name: render_date(values[name], True) if kind == "d" and values[name] is not None else values[name] for name, kind in spec if name != skip}
    if not any(map(_odd, out.values())):
        return _encode(out)
    return "{" + ",".join(f"{_encode(name)}:{number_text(v) if type(v) is float else _encode(v)}" for name, v in out.items()) + "}"


def parse_page(data: bytes) -> dict:
    """The 33 columns of a page; Invalid with the prefix parse/validate: otherwise."""
    try:
        page = _decoder.decode(data.decode("utf-8"))
        if not isinstance(page, _Object):
            raise _wrong("page", page, "an object")
        props = _member(page, "pageProps")
        marks = [m for m in ("__N_SSG", "__N_SSP") if m in page]
        if len(marks) > 1 or set(marks) & page.repeated:
            raise Invalid("duplicate field `__N_SSG`")
        if not marks:
            raise Invalid("missing field `__N_SSG`")
        if not isinstance(page[marks[0]], bool):
            raise _wrong("__N_SSG", page[marks[0]], "a boolean")
        if not isinstance(props, _Object):
            raise _wrong("pageProps", props, "an object")
        owner = _member(props, "job")
        job = _record(owner, _JOB, "job")
        info = _record(_member(owner, "job_information"), _INFO, "job_information")
        v5 = _record(_member(owner, "v5_processed_job_data"), _V5, "v5_processed_job_data")
        if "enriched_company_data" in owner.repeated or "_geoloc" in owner.repeated:
            raise Invalid("duplicate field")
        company = owner.get("enriched_company_data")
        ec = None if company is None else _record(company, _EC, "enriched_company_data")
        points = owner.get("_geoloc", [])
        if not isinstance(points, list):
            raise _wrong("_geoloc", points, "a sequence")
        points = [_record(p, [("lat", "n"), ("lon", "n")], "_geoloc") for p in points]
        if any(v is None for p in points for v in p.values()):
            raise Invalid("missing field `lat` or `lon`")
    except RecursionError as e:
        raise Invalid("parse/validate: recursion limit exceeded") from e
    except ValueError as e:  # Invalid, bad JSON, bad UTF-8
        raise Invalid(f"parse/validate: {e}") from e
    date = v5["estimated_publish_date"]
    taken = ("core_job_title", "job_category", "seniority_level", "role_type", "workplace_type", "formatted_workplace_location")
    paid = ("min_industry_and_role_yoe", "yearly_min_compensation", "yearly_max_compensation", "listed_compensation_currency")
    return {
        **{c: job[c] for c in ("id", "source", "board_token", "apply_url", "requisition_id", "collapse_key", "is_expired")},
        **{c: info[c] for c in ("title", "job_title_raw", "description")},
        **{c: v5[c] for c in taken},
        "workplace_countries": _encode(v5["workplace_countries"]),
        **{c: v5[c] for c in paid},
        "technical_tools": _encode(v5["technical_tools"]),
        "estimated_publish_date": None if date is None else render_date(date, False),
        "company_name": v5["company_name"],
        "company_website": v5["company_website"],
        "enriched_status": ec and ec["status"],
        "nb_employees": ec and ec["nb_employees"],
        "year_founded": ec and ec["year_founded"],
        "latitude": points[0]["lat"] if points else None,
        "longitude": points[0]["lon"] if points else None,
        "job_information_json": _blob(info, _INFO, skip="description"),
        "v5_processed_job_data_json": _blob(v5, _V5),
        "enriched_company_data_json": None if ec is None else _blob(ec, _EC),
    }


def process(data: bytes | None) -> tuple[dict | None, str | None]:
    """(row, None) or (None, error) of a gzipped page."""
    try:
        return parse_page(decode_gzipped(data)), None
    except Invalid as e:
        return None, str(e)


