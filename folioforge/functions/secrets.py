"""Credentials in texts: what they look like, masking and counting them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands in place of a secret, and of an identifier in a note.
MASK, NOTE_MASK = "[secret masqué par le hook]", "[identifiant masqué]"
# Words in the name of a variable that holds a secret. A name may have any prefix and suffix.
NAMED = ("TOKEN", "SECRET", "PASSWORD", "PASSWD", "PASSPHRASE", "API[_-]?KEY", "ACCESS[_-]?KEY", "PRIVATE[_-]?KEY", "CREDENTIAL", "CLIENT[_-]?SECRET", "AUTH")
# Secrets that an issuer's own form gives away, with what may follow the prefix.
ISSUED = (
    r"sk-[A-Za-z0-9_-]{16,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"hf_[A-Za-z0-9]{20,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"AKIA[0-9A-Z]{16}\b",
    r"AIza[0-9A-Za-z_-]{35}\b",
)

_PART = "[A-Za-z0-9_.-]*"
NAME = f"{_PART}(?:{'|'.join(NAMED)}){_PART}"
#: A value that is masked already is left alone.
_FRESH = r"(?!\[secret)"
# The patterns in the order in which they apply; what the first group holds stays. Lines end with \n only.
KEPT = (
    rf"(?imd)^(\s*(?:export\s+)?{NAME}\s*[:=]\s*)[^\n]+$",
    rf"(?i)\b(authorization\s*:\s*(?:bearer|basic)\s+){_FRESH}\S+",
    rf"""(?i)\b({NAME}\s*[:=]\s*){_FRESH}(?:"[^"]*"|'[^']*'|[^\s,;)}}\]]+)""",
)
WHOLE = (*(rf"\b{form}" for form in ISSUED), r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----")
PATTERNS = (*((p, f"$1{MASK}") for p in KEPT), *((p, MASK) for p in WHOLE))
#: What any of them needs somewhere in the text; texts without it are not searched.
_HINT = rf"(?i){'|'.join(NAMED)}|sk-|gh[pousr]_|hf_|xox|AKIA|AIza|PRIVATE KEY"
#: An assignment to a name that says secret, or a form of an issuer; for reports that count and show nothing.
FOUND = rf"(?i)\b{NAME}\s*[:=]\s*\S+|\b(?:{'|'.join(ISSUED)})"


def masked(x: Column, mask: str = MASK) -> Column:
    """The text with the values of its secrets masked; a variable's name stays. Too much is masked rather than too little."""
    out = x
    for pattern, instead in PATTERNS:
        out = F.regexp_replace(out, pattern, instead.replace(MASK, mask))
    return F.when(x.rlike(_HINT), out).otherwise(x)


def masked_count(x: Column) -> Column:
    """How many secrets masked() replaces, pattern after pattern."""
    total, now = F.lit(0), x
    for pattern, instead in PATTERNS:
        total = total + F.regexp_count(now, F.lit(pattern))
        now = F.regexp_replace(now, pattern, instead)
    return F.when(x.rlike(_HINT), total).when(x.isNotNull(), F.lit(0))


def found_count(x: Column) -> Column:
    """How many secrets a text shows; the values stay where they are."""
    return F.when(x.rlike(_HINT), F.regexp_count(x, F.lit(FOUND))).otherwise(F.lit(0))
