"""Constraint rules, redaction and refusal, as columns and for single values."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WorkflowError
from ..functions.codec import encode_ordered

# What counts as private.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
SECRET = r"(api[_-]?key|token|password)(\s*[=:]\s*)[^\s]+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
BEARER = r"\b[Bb][Ee][Aa][Rr][Ee][Rr]\s+[A-Za-z0-9._-]+"
SECRET_NAME = r"(?i)password|secret|credential|api.?key|authorization|cookie|access.?token"
SECRET_MEMBER = r'(?i)"[^"]*(password|secret|credential|api.?key|authorization|cookie|access.?token)[^"]*"\s*:'
URL = r'https?://[^\s"<>]+'
ORIGIN = r"^(https?://[^/?#@]+)(/[^?#]*)?$"
CONTROL = r"[\x00-\x1F\x7F]"
CAP = 600


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the names of the broken rules, in the order given; a rule that is null holds."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])))


def redact(text: Column, secrets: tuple[str, ...] = (), named: str = "$1$2[redacted]", spaces: str = r"\s") -> Column:
    """Addresses, named secrets, given secrets and URLs replaced, control characters as spaces.

    ``named`` is what stands for a named secret, its name ($1) and sign ($2) included; ``spaces`` are the members of white space.
    """
    clean = text
    for s in secrets:
        clean = F.replace(clean, F.lit(s), F.lit("[redacted]"))
    clean = F.regexp_replace(clean, MAIL, "[redacted]")
    clean = F.regexp_replace(clean, SECRET.replace(r"[^\s]", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"), named)
    clean = F.regexp_replace(clean, rf"https?://[^{spaces}]+", "[redacted URL]")
    return F.regexp_replace(clean, CONTROL, " ")


def capped(text: Column, most: int = CAP) -> Column:
    """The first characters of a diagnostic; the limit is the feature."""
    return F.left(text, F.lit(most))


def foreign_urls(text: Column, origins: tuple[str, ...] | list[str]) -> Column:
    """URLs that an export may not hold: with user, query or fragment, or of an origin that is not listed."""
    allowed = F.array(*[F.lit(o) for o in origins]) if origins else F.array().cast("array<string>")
    return F.filter(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: ~F.array_contains(allowed, F.lower(F.regexp_extract(u, ORIGIN, 1))))


def refusals(df: DataFrame, text: str = "text", origins: tuple[str, ...] = (), secrets: tuple[str, ...] = ()) -> DataFrame:
    """Adds the reasons why a text may not be exported, in a fixed order; none for a clean one or null."""
    c = F.col(text)
    rules = {
        "mail": c.rlike(MAIL), "named_secret": c.rlike(SECRET), "private_key": c.rlike(PRIVATE_KEY), "bearer": c.rlike(BEARER), "secret_member": c.rlike(SECRET_MEMBER), "url": F.size(foreign_urls(c, origins)) > 0,
    }
    if secrets:
        rules["given_secret"] = F.greatest(*[F.contains(c, F.lit(s)) for s in (*secrets, secrets[0])])
    return violations(df, rules)


def _parts(value: Any) -> Iterator[tuple[str, str]]:
    """("name", n) and ("text", t) of everything in a value."""
    if isinstance(value, list):
        for v in value:
            yield from _parts(v)
    elif isinstance(value, dict):
        for name, v in value.items():
            yield "name", name
            yield from _parts(v)
    elif isinstance(value, str):
        yield "text", value


def export_text(value: Any, approved: bool, origins: tuple[str, ...] = (), secrets: tuple[str, ...] = ()) -> str:
    """Text of a value that may be shown; anything private in it, or no approval, is an error that does not tell the content."""

    def refuse(why: str) -> None:
        raise WorkflowError("private_export", "export", why=why)

    if not approved:
        refuse("not_approved")
    text = encode_ordered(value)
    for why, found in (("private_key", re.search(PRIVATE_KEY, text)), ("bearer", re.search(BEARER, text)), ("mail", re.search(MAIL, text)), ("given_secret", any(s and s in text for s in secrets))):
        if found:
            refuse(why)
    for kind, s in _parts(value):
        if kind == "name" and re.search(SECRET_NAME, s):
            refuse("secret_member")
        if any(x and x in s for x in secrets):
            refuse("given_secret")
        for url in re.findall(URL, s) if kind == "text" else ():
            u = urlsplit(url)
            if u.username is not None or u.password is not None or u.query or u.fragment or f"{u.scheme}://{u.netloc}".lower() not in origins:
                refuse("url")
    return text
