"""Column builders: each takes and returns ``Column`` and stays inside codegen."""

from veilframe.functions.dates import age_bucket, parse_date, shift_date, unreadable_date
from veilframe.functions.identifiers import (
    as_identifier,
    date_offset,
    encounter_key,
    missing_id_key,
    patient_key,
    provider_key,
)
from veilframe.functions.places import coarsen_zip, suppress_small_zip
from veilframe.functions.redaction import (
    PII_PATTERNS,
    matches_pii,
    redact_email,
    redact_mrn,
    redact_notes,
    redact_numbers,
    redact_phone,
    redact_ssn,
)
from veilframe.functions.values import note_or_default, preview, to_cost, to_label

__all__ = [
    "PII_PATTERNS",
    "age_bucket",
    "as_identifier",
    "coarsen_zip",
    "date_offset",
    "encounter_key",
    "missing_id_key",
    "matches_pii",
    "note_or_default",
    "parse_date",
    "patient_key",
    "preview",
    "provider_key",
    "redact_email",
    "redact_mrn",
    "redact_notes",
    "redact_numbers",
    "redact_phone",
    "redact_ssn",
    "shift_date",
    "suppress_small_zip",
    "to_cost",
    "to_label",
    "unreadable_date",
]
