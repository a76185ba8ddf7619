"""JSON text of values: an ordered form that keeps key order, and a sorted one.

Values are null, booleans, finite numbers, strings, arrays and objects with
string keys.  Numbers print as ECMAScript prints them; integers beyond 2^53,
NaN, infinities and negative zero are refused, as are sets, bytes, tuples, dates
and other objects.  In the ordered form, keys that are array indexes come first
in ascending order, as an ECMAScript object enumerates them.  In the sorted form
keys are in the order of their UTF-16 code units.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

from ..errors import WorkflowError

SAFE = 2**53 - 1
_INDEX = re.compile(r"(0|[1-9][0-9]{0,9})\Z")


def number_text(x: int | float) -> str:
    """The shortest text that reads back as x, with an exponent from 1e21 up and below 1e-6."""
    if isinstance(x, int):
        if abs(x) > SAFE:
            raise WorkflowError("invalid_value", "encode", "integer beyond 2^53")
        return str(x)
    if not math.isfinite(x) or (x == 0 and math.copysign(1, x) < 0):
        raise WorkflowError("invalid_value", "encode", "not a finite number, or negative zero")
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + ("" if part == "0" else part)).lstrip("0")
    point = len(whole) + int(exponent or 0) if whole != "0" else int(exponent or 0) - (len(part) - len(part.lstrip("0")))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    tail = f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + tail


def string_text(s: str) -> str:
    """JSON text of a string; lone surrogates are escaped."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", json.dumps(s, ensure_ascii=False))


def _is_index(key: str) -> bool:
    return bool(_INDEX.match(key)) and int(key) < 2**32 - 1


def ordered_keys(keys: list[str]) -> list[str]:
    return sorted((k for k in keys if _is_index(k)), key=int) + [k for k in keys if not _is_index(k)]


def sorted_keys(keys: list[str]) -> list[str]:
    return sorted(keys, key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def _encode(value: Any, arrange) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if type(value) in (int, float):
        return number_text(value)
    if type(value) is str:
        return string_text(value)
    if type(value) is list:
        return "[" + ",".join([_encode(v, arrange) for v in value]) + "]"
    if type(value) is dict:
        if not all(type(k) is str for k in value):
            raise WorkflowError("invalid_value", "encode", "object key is not a string")
        return "{" + ",".join([string_text(k) + ":" + _encode(value[k], arrange) for k in arrange(list(value))]) + "}"
    raise WorkflowError("invalid_value", "encode", f"no JSON form for {type(value).__name__}")


def encode_ordered(value: Any) -> str:
    return _encode(value, ordered_keys)


def encode_sorted(value: Any) -> str:
    return _encode(value, sorted_keys)


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise WorkflowError("invalid_encoding", "decode", "duplicate key")
    return out


def _float(text: str) -> float | int:
    x = float(text)
    return int(x) if x.is_integer() and abs(x) <= SAFE and not (x == 0 and text.startswith("-")) else x


def decode(data: bytes | str, form: str = "ordered") -> Any:
    """Strict: UTF-8 without a mark, no duplicate keys, and byte-equal when encoded again."""
    try:
        text = data.decode("utf-8") if isinstance(data, bytes) else data
        value = json.loads(text, object_pairs_hook=_pairs, parse_float=_float, parse_constant=lambda _: float("nan"))
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise WorkflowError("invalid_encoding", "decode", "not JSON text") from e
    if (encode_ordered if form == "ordered" else encode_sorted)(value) != text:
        raise WorkflowError("invalid_encoding", "decode", "not in canonical form")
    return value


def kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]
