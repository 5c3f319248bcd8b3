"""Pseudonyms and per-patient date offsets as pure functions of the raw id.

Nothing is looked up or remembered: the same id and salt give the same value on
every executor, in batch and in streams, so linking tables needs no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a pseudonym looks like and how offsets are derived.
PATIENT_PREFIX = "DEID-"
ENCOUNTER_PREFIX = "ENC-"
PROVIDER_PREFIX = "PROV-"
PATIENT_KEY_HEX = 12
ENCOUNTER_KEY_HEX = 10
OFFSET_CYCLE_DAYS = 360
OFFSET_LOWEST_DAY = -180
OFFSET_INSTEAD_OF_ZERO = 42
NULL_ID_TEXT = "nan"


def as_identifier(raw_id: Column) -> Column:
    """Text that gets hashed; null ids share one well-known text and are audited."""
    return F.coalesce(raw_id.cast("string"), F.lit(NULL_ID_TEXT))


def _salted_key(raw_id: Column, salt: str, prefix: str, hex_len: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{salt}_"), as_identifier(raw_id)), 256)
    key = F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, hex_len)))
    # The key is never null, but Spark takes sha2 for nullable and would hash every row
    # a second time before a join, only to test for null.
    return F.coalesce(key, F.lit(prefix))


def patient_key(raw_id: Column, salt: str, hex_len: int = PATIENT_KEY_HEX) -> Column:
    """Salted SHA-256 pseudonym. 12 hex digits are 48 bits; raise ``hex_len`` for
    registries above some ten million patients and check with
    ``operators.audit.pseudonym_collisions``."""
    return _salted_key(raw_id, salt, PATIENT_PREFIX, hex_len)


def missing_id_key(salt: str, hex_len: int = PATIENT_KEY_HEX) -> str:
    """The pseudonym all null ids share."""
    digest = hashlib.sha256(f"{salt}_{NULL_ID_TEXT}".encode()).hexdigest()
    return PATIENT_PREFIX + digest[:hex_len].upper()


def provider_key(raw_id: Column, salt: str, hex_len: int = PATIENT_KEY_HEX) -> Column:
    """Pseudonym of a provider; a null provider stays null."""
    return F.when(raw_id.isNotNull(), _salted_key(raw_id, salt, PROVIDER_PREFIX, hex_len))


def encounter_key(raw_id: Column, hex_len: int = ENCOUNTER_KEY_HEX, salt: str | None = None) -> Column:
    """MD5 pseudonym of an encounter, unsalted unless ``salt`` is given."""
    text = as_identifier(raw_id)
    if salt is not None:
        text = F.concat(F.lit(f"{salt}_"), text)
    return F.concat(F.lit(ENCOUNTER_PREFIX), F.upper(F.substring(F.md5(text), 1, hex_len)))


def date_offset(raw_id: Column, salt: str) -> Column:
    """Days to shift every date of this patient: the salted MD5 as a 128-bit number,
    modulo 360, less 180, never zero.

    No Spark type holds 128 bits, so the digest is reduced in pieces of at most
    60 bits, carrying the remainder along (Horner's rule).
    """
    digest = F.md5(F.concat(F.lit(f"offset_{salt}_"), as_identifier(raw_id)))
    piece_hex = 15
    carry = 16**piece_hex % OFFSET_CYCLE_DAYS

    def piece(start: int, length: int) -> Column:
        return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")

    remainder = F.pmod(piece(1, 2) * carry + piece(3, piece_hex), F.lit(OFFSET_CYCLE_DAYS))
    remainder = F.pmod(remainder * carry + piece(18, piece_hex), F.lit(OFFSET_CYCLE_DAYS))
    days = (remainder + OFFSET_LOWEST_DAY).cast("int")
    return days + (days == 0).cast("int") * OFFSET_INSTEAD_OF_ZERO
