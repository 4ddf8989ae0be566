"""Credentials do not leave the process: masked in strings and columns by form, and in strings by value where one is known."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "REDACTED"

#: Words that name a secret, in any spelling with blanks, dashes or underscores.
NAMES = ("pass word", "pass wd", "pwd", "pass phrase", "secret", "secret key", "client secret", "access key", "access token", "refresh token", "auth token", "token", "api key", "private key", "session key", "sas", "sig", "credentials")
#: Published beginnings of issued tokens, with the fewest characters that follow.
ISSUED = {
    "AKIA": 16, "ASIA": 16, "ghp_": 12, "gho_": 12, "ghs_": 12, "ghu_": 12, "github_pat_": 20, "glpat-": 16, "xoxb-": 10, "xoxp-": 10, "sk-": 16, "sk_live_": 12, "rk_live_": 12, "AIza": 30, "ya29.": 20, "hf_": 20, "npm_": 20, "dop_v1_": 30, "SG.": 20,
}


def _forms() -> list[tuple[str, str]]:
    """``(kept, hidden)`` of each form of a credential, in syntax that Python and Java share."""
    names = "|".join(n.replace(" ", "[-_ ]?") for n in sorted(NAMES, key=len, reverse=True))
    issued = "|".join(f"{re.escape(start)}[\\w.+/=-]{{{least},}}" for start, least in ISSUED.items())
    return [
        (r"//[^\s/@:]*:", r"[^\s/@][^\s@]*(?=@)"),  # the password of an address
        (rf"(?i:[\"'\w-]*(?:{names})[\"']?\s*(?:=|:|=>)\s*[\"']?)", r"(?!//)[^\s\"'&,;}]+"),  # a named value, in options, JSON or settings
        (r"(?i:(?:proxy-)?authorization[\"']?\s*[:=]\s*[\"']?(?:[a-z]+ )?)", r"[^\s\"',]{4,}"),  # a header
        (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"[\s\S]+?(?=-----END|\z)"),
        (r"\beyJ", r"[\w-]{10,}\.[\w-]{6,}(?:\.[\w-]*)?"),  # a signed token
        (r"(?<![\w-])", rf"(?:{issued})"),
    ]


FORMS = _forms()
_COMPILED = [re.compile(f"({kept})({hidden})".replace("\\z", "\\Z")) for kept, hidden in FORMS]
_known: set[str] = set()


def remember(secret: str | None) -> None:
    """Mask this value wherever it turns up from now on: the passwords and keys that targets are opened with."""
    if secret and len(secret) >= 4:
        _known.add(secret)


def redact(text: str | None) -> str | None:
    """Mask credentials in a string."""
    if not text:
        return text
    for value in sorted(_known, key=len, reverse=True):
        text = text.replace(value, MASK)
    for form in _COMPILED:
        text = form.sub(lambda m: m[1] + (m[2] if m[2].startswith(MASK) else MASK), text)
    return text


def redact_column(c: Column) -> Column:
    """The same forms on a column; values that are only known to this process are not looked for."""
    for kept, hidden in FORMS:
        c = F.regexp_replace(c, f"({kept})({hidden})", f"$1{MASK}")
    return c


def leaks(text: str) -> bool:
    """Whether a string still holds something that looks like a credential, or a known one."""
    return any(v in text for v in _known) or any(not m[2].startswith(MASK) for form in _COMPILED for m in form.finditer(text))


class RedactingFilter(logging.Filter):
    """Masks credentials in log records."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redact(record.getMessage()), None
        return True
