"""Column-level building blocks: seeds, providers, suffixes, checks and coercions."""

from maskframe.functions.checks import is_fake_ssn, passes_luhn, redact, redact_fields, safe_preview
from maskframe.functions.coerce import coerce_to
from maskframe.functions.providers import (
    check_providers,
    known_providers,
    register_provider,
    restore_builtin_providers,
)
from maskframe.functions.seeds import Seed, keyed_digest, seed_hex
from maskframe.functions.text import nfc, python_str
from maskframe.functions.unique import (
    unique_date,
    unique_email,
    unique_numeric,
    unique_suffix,
    unique_text,
)

__all__ = [
    "Seed", "check_providers", "coerce_to", "is_fake_ssn", "keyed_digest", "known_providers",
    "nfc", "passes_luhn", "python_str", "redact", "redact_fields", "register_provider",
    "restore_builtin_providers", "safe_preview", "seed_hex", "unique_date", "unique_email",
    "unique_numeric", "unique_suffix", "unique_text",
]
