"""Deterministic 128-bit seeds and the arithmetic providers do on them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.text import segment, segment_column

# Seed bytes split so that every limb is a non-negative long: 7 + 7 + 2 bytes.
LIMB_BYTES = (7, 7, 2)
_SEED_BYTES = sum(LIMB_BYTES)
_HMAC_BLOCK = 64


def seed_hex(normalized: Column, salt: str, path: str) -> Column:
    """First 16 bytes, as hex, of sha256 over the length-prefixed salt, path and value."""
    prefix = F.lit(bytearray(segment(salt) + segment(path)))
    return F.substring(F.sha2(F.concat(prefix, segment_column(normalized)), 256), 1, 32)


def keyed_digest(normalized: Column, key: str, path: str) -> Column:
    """HMAC-SHA256 (64 hex digits) over the length-prefixed path and value."""
    raw = key.encode()
    if len(raw) > _HMAC_BLOCK:
        raw = hashlib.sha256(raw).digest()
    block = raw.ljust(_HMAC_BLOCK, b"\0")
    inner_pad = bytes(b ^ 0x36 for b in block)
    outer_pad = bytes(b ^ 0x5C for b in block)
    inner = F.sha2(
        F.concat(F.lit(bytearray(inner_pad + segment(path))), segment_column(normalized)), 256
    )
    return F.sha2(F.concat(F.lit(bytearray(outer_pad)), F.unhex(inner)), 256)


class Seed:
    """Seed bytes of the current row: ``hex`` (32 digits) and the numbers taken from it.

    ``define`` may replace each number by a reference to a helper column computed in an
    earlier select, where the hex conversions are shared and providers can use the number
    often without repeating its code.
    """

    def __init__(
        self, hex_seed: Column, define: Callable[[Column], Column] | None = None
    ) -> None:
        self.hex = hex_seed
        self._define = define or (lambda residue: residue)
        self._defined: dict[tuple[str, int, int], Column] = {}
        self._limbs: list[Column] = []
        start = 1
        for size in LIMB_BYTES:
            digits = F.substring(hex_seed, start, 2 * size)
            self._limbs.append(F.conv(digits, 16, 10).cast("long"))
            start += 2 * size

    def _residue(self, kind: str, n: int, skip: int, build: Callable[[], Column]) -> Column:
        key = (kind, n, skip)
        if key not in self._defined:
            self._defined[key] = self._define(build())
        return self._defined[key]

    def byte(self, index: int) -> Column:
        """One byte of the seed as a long in 0..255."""
        return self._residue("byte", 256, index, lambda: self._raw_byte(index))

    def _raw_byte(self, index: int) -> Column:
        for limb, size in zip(self._limbs, LIMB_BYTES, strict=True):
            if index < size:
                return F.shiftright(limb, 8 * (size - 1 - index)).bitwiseAND(F.lit(255))
            index -= size
        raise IndexError("a seed has 16 bytes")

    def mod(self, n: int, skip: int = 0) -> Column:
        """Big-endian integer of the bytes after ``skip``, modulo ``n``.

        A long up to moduli of 63 bits, and a decimal beyond.
        """
        if n < 1:
            raise ValueError("modulus must be >= 1")
        parts = self._tail(skip)
        if n.bit_length() > 54:
            fold = self._decimal
        else:
            fold = self._weighted if n.bit_length() <= 30 else self._horner
        return self._residue("mod", n, skip, lambda: fold(parts, n))

    def digits(self) -> Column:
        """The whole seed as a number of 54 decimal digits, zeros in front."""
        return self._residue("digits", 0, 0, self._decimal_digits)

    def _decimal_digits(self) -> Column:
        """Three numbers of 18 digits, carried on while the limbs are fed in from the top."""
        base = F.lit(10**18).cast("decimal(19,0)")

        def carry(value: Column) -> tuple[Column, Column]:
            low = (value % base).cast("decimal(18,0)")
            return low, ((value - low) / base).cast("decimal(20,0)")

        def shifted(value: Column, bits: int, more: Column) -> Column:
            return (value * F.lit(1 << bits).cast("decimal(18,0)") + more).cast("decimal(38,0)")

        first, second, third = [limb.cast("decimal(18,0)") for limb in self._limbs]
        low, middle = carry(shifted(first, 8 * LIMB_BYTES[1], second))
        low, over = carry(shifted(low, 8 * LIMB_BYTES[2], third))
        middle, high = carry(shifted(middle, 8 * LIMB_BYTES[2], over))
        return F.concat(*[F.lpad(part.cast("decimal(18,0)").cast("string"), 18, "0") for part in (high, middle, low)])

    def reversed_mod(self, n: int) -> Column:
        """The same with the byte order reversed."""
        def build() -> Column:
            total = F.lit(0).cast("long")
            for i in range(_SEED_BYTES):
                total = total + self._raw_byte(i) * F.lit(pow(256, i, n))
            return total % F.lit(n)

        return self._residue("reversed", n, 0, build)

    def _tail(self, skip: int) -> list[tuple[Column, int]]:
        parts = []
        for limb, size in zip(self._limbs, LIMB_BYTES, strict=True):
            dropped = min(skip, size)
            skip -= dropped
            bits = 8 * (size - dropped)
            if bits:
                parts.append((limb.bitwiseAND(F.lit((1 << bits) - 1)) if dropped else limb, bits))
        return parts

    @staticmethod
    def _weighted(parts: list[tuple[Column, int]], n: int) -> Column:
        """Sum of limb residues times the residue of their weight; products stay below 2^60."""
        shift = sum(bits for _, bits in parts)
        total = None
        for limb, bits in parts:
            shift -= bits
            term = (limb % F.lit(n)) * F.lit(pow(2, shift, n))
            total = term if total is None else total + term
        return total % F.lit(n)

    @staticmethod
    def _decimal(parts: list[tuple[Column, int]], n: int) -> Column:
        """The same in decimals of 38 digits, which hold 126 bits."""
        step = min(56, 126 - n.bit_length())
        if step < 8:
            raise ValueError("moduli above 118 bits do not fit a decimal; use digits()")
        modulus, rest = F.lit(str(n)).cast("decimal(38,0)"), None
        for limb, bits in parts:
            while bits:
                width = min(step, bits)
                bits -= width
                piece = F.shiftright(limb, bits).bitwiseAND(F.lit((1 << width) - 1)).cast("decimal(38,0)")
                if rest is not None:
                    weight = F.lit(str(1 << width)).cast("decimal(38,0)")
                    piece = ((rest * weight).cast("decimal(38,0)") + piece).cast("decimal(38,0)")
                rest = (piece % modulus).cast("decimal(38,0)")
        return rest.cast("long") if n.bit_length() <= 63 else rest

    @staticmethod
    def _horner(parts: list[tuple[Column, int]], n: int) -> Column:
        """Feed the bits from the top in pieces small enough for long arithmetic."""
        step = 62 - n.bit_length()
        rest = None
        for limb, bits in parts:
            while bits:
                width = min(step, bits)
                bits -= width
                piece = F.shiftright(limb, bits).bitwiseAND(F.lit((1 << width) - 1))
                rest = piece % F.lit(n) if rest is None else (rest * F.lit(1 << width) + piece) % F.lit(n)
        return rest
