"""Run-wide masking inputs: secrets, the reference date and the tunable constants."""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass, field

MIN_KEY_BYTES = 32


class MaskError(ValueError):
    """A rule that cannot be applied. Messages name columns, never cell values."""


@dataclass(frozen=True)
class MaskContext:
    """Everything a masking expression depends on besides the row itself.

    ``as_of`` replaces the wall clock for age arithmetic, so a plan is a pure function of
    its inputs. ``nfc`` picks how text is normalised before seeding: ``"jvm"`` (ordinary
    expressions), ``"arrow"`` (Python worker) or ``"off"`` for columns known to be
    normalised already.
    """

    salt: str = field(repr=False)
    key: str | None = field(default=None, repr=False)
    as_of: dt.date | None = None
    nfc: str = "jvm"
    email_domains: tuple[str, ...] = ("fakedom.net", "example.test", "example.org")
    password: str = "masked-test-pw"
    redact_pepper: str = field(default="maskframe-redact-v1", repr=False)

    def __post_init__(self) -> None:
        if not self.salt:
            raise MaskError("salt must not be empty")
        if self.key is not None and len(self.key.encode()) < MIN_KEY_BYTES:
            raise MaskError(f"pseudonym key must be at least {MIN_KEY_BYTES} bytes")
        if self.nfc not in ("jvm", "arrow", "off"):
            raise MaskError(f"unknown nfc mode: {self.nfc!r}")

    def require_key(self, path: str) -> str:
        if self.key is None:
            raise MaskError(f"{path}: keyed actions need MaskContext(key=...)")
        return self.key

    def require_as_of(self, path: str) -> dt.date:
        if self.as_of is None:
            raise MaskError(f"{path}: the dob provider needs MaskContext(as_of=...)")
        return self.as_of

    @property
    def salt_fingerprint(self) -> str:
        """Non-reversible identifier of the salt, safe to store with a run."""
        return hashlib.sha256(self.salt.encode()).hexdigest()[:16]
