"""Free-text redaction and residual-identifier checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an identifier in free text, and what replaces it.
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
MRN = r"\b(?:MRN|mrn|Patient ID|ID):\s*([A-Za-z0-9\-]+)\b"
SSN_MASK = "[REDACTED_SSN]"
PHONE_MASK = "[REDACTED_PHONE]"
EMAIL_MASK = "[REDACTED_EMAIL]"
MRN_MASK = "MRN: [REDACTED_MRN]"

# ``U`` gives \b, \d and \s their Unicode meaning, as Java's default is ASCII; the four
# separator controls still miss from its \s.
PII_PATTERNS = {
    "ssn": f"(?U){SSN}",
    "phone": f"(?U){PHONE}",
    "email": f"(?U){EMAIL}",
    "mrn": f"(?iU){MRN}".replace(r"\s", r"[\s\x1c-\x1f]"),
}
PII_MASKS = {"ssn": SSN_MASK, "phone": PHONE_MASK, "email": EMAIL_MASK, "mrn": MRN_MASK}


# What a text must hold for a pattern to have any chance: four digits in a row end
# every SSN and phone number, an SSN has hyphens, an email its @ and a record number its
# colon. These tests are exact, cost a fraction of the pattern, and most texts fail them.
_FOUR_DIGITS = r"(?U)\d{4}"
_NEEDED = {"ssn": "-", "email": "@", "mrn": ":"}


def _may_hold(text: Column, check: str) -> Column:
    return text.contains(_NEEDED[check]) if check in _NEEDED else text.rlike(_FOUR_DIGITS)


def _replace(text: Column, check: str) -> Column:
    return F.regexp_replace(text, PII_PATTERNS[check], PII_MASKS[check])


def _redact(text: Column, check: str) -> Column:
    return F.when(_may_hold(text, check), _replace(text, check)).otherwise(text)


def redact_ssn(text: Column) -> Column:
    return _redact(text, "ssn")


def redact_phone(text: Column) -> Column:
    return _redact(text, "phone")


def redact_email(text: Column) -> Column:
    return _redact(text, "email")


def redact_mrn(text: Column) -> Column:
    return _redact(text, "mrn")


def redact_numbers(text: Column) -> Column:
    """SSN, then phone numbers."""
    return F.when(_may_hold(text, "phone"), _replace(_redact(text, "ssn"), "phone")).otherwise(text)


def redact_notes(text: Column) -> Column:
    """SSN, phone, email, MRN in this order over the whole text; null becomes empty.

    Testing the original text is enough: no mask put in on the way holds a digit, an
    ``@`` or a colon.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    numbers = redact_numbers(text)
    emails = F.when(_may_hold(text, "email"), _replace(numbers, "email")).otherwise(numbers)
    return F.when(_may_hold(text, "mrn"), _replace(emails, "mrn")).otherwise(emails)


def matches_pii(text: Column, check: str) -> Column:
    """True where ``text`` holds an identifier of the kind ``check``; null text has none."""
    found = _may_hold(text, check) & text.rlike(PII_PATTERNS[check])
    return F.coalesce(found, F.lit(False))
