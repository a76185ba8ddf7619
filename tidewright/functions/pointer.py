"""JSON pointers over values, with absent told apart from null."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import WorkflowError

MISSING = object()


def escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def parts(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise WorkflowError("invalid_pointer", "resolve", pointer=pointer)
    out = []
    for raw in pointer[1:].split("/"):
        if raw.replace("~0", "").replace("~1", "").count("~"):
            raise WorkflowError("invalid_pointer", "resolve", pointer=pointer)
        out.append(raw.replace("~1", "/").replace("~0", "~"))
    return out


def resolve(value: Any, pointer: str) -> Any:
    """The value there, or MISSING; array indexes have no leading zeros."""
    for name in parts(pointer):
        if isinstance(value, dict) and name in value:
            value = value[name]
        elif isinstance(value, list) and name.isascii() and name.isdigit() and (name == "0" or name[0] != "0") and int(name) < len(value):
            value = value[int(name)]
        else:
            return MISSING
    return value


def select_inputs(inputs: Any, pointers: dict[str, str] | list[str], contract: str = "required-json-v1") -> dict[str, Any]:
    """{pointer: {contract, state, value?}}: what a stage declares to read."""
    out = {}
    for p in sorted(pointers):
        got = resolve(inputs, p)
        own = pointers[p] if isinstance(pointers, dict) else contract
        out[p] = {"contract": own, "state": "missing"} if got is MISSING else {"contract": own, "state": "present", "value": got}
    return out


def project_inputs(inputs: Any, pointers: list[str] | tuple[str, ...]) -> dict[str, Any]:
    """{pointer: value} of the pointers that lead anywhere; missing ones are left out."""
    found = {p: resolve(inputs, p) for p in pointers}
    return {p: v for p, v in found.items() if v is not MISSING}


def pointer_column(document: Column, pointer: str) -> Column:
    """The value at a pointer of a JSON text, as a variant; SQL null where it leads nowhere.

    A JSON null that is there is a variant null, which is not SQL null.  A text
    that is no JSON document, or has a name twice, leads nowhere.  A name with
    both kinds of quotes can't be asked for here.
    """
    at = F.try_parse_json(document)
    for name in parts(pointer):
        quote = "'" if '"' in name else '"'
        if quote in name:
            raise WorkflowError("unsupported_pointer", "resolve", pointer=pointer)
        steps = [F.try_variant_get(at, f"$[{quote}{name}{quote}]", "variant")]
        if name.isascii() and name.isdigit() and (name == "0" or name[0] != "0") and int(name) < 2**31:
            steps.append(F.try_variant_get(at, f"$[{name}]", "variant"))
        at = F.coalesce(*steps)
    return at


def pointer_text(document: Column, pointer: str) -> Column:
    """The same as text: strings as they are, other values as JSON; null for a JSON null and where the pointer leads nowhere."""
    found = pointer_column(document, pointer)
    return F.when(F.is_variant_null(found), None).otherwise(F.coalesce(F.try_variant_get(found, "$", "string"), F.to_json(found)))


def pointer_state(document: Column, pointer: str) -> Column:
    """present or missing."""
    return F.when(pointer_column(document, pointer).isNull(), "missing").otherwise("present")
