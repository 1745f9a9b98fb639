"""64-bit perceptual hashes as Column expressions.

A hash travels as 16 hex characters and is compared as one signed 64-bit integer, so a distance is
one xor and one bit count inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediamatch.schema import HASH_BITS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid_hash(phash: Column | str) -> Column:
    return F.lower(_col(phash)).rlike("^[0-9a-f]{16}$")


def hash_to_long(phash: Column | str) -> Column:
    """Hex text to the signed integer with the same 64 bits; null when the text is not a hash."""
    # The signed target base keeps values above 2^63 inside BIGINT.
    return F.when(is_valid_hash(phash), F.conv(_col(phash), 16, -10).cast("bigint"))


def long_to_hash(bits: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(_col(bits))), 16, "0")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit integers."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hex hashes; hashes of unequal length count as 64 apart."""
    a, b = _col(a), _col(b)

    def piece(c: Column, at: Column) -> Column:
        return F.coalesce(F.conv(F.substr(c, at, F.lit(15)), 16, 10).cast("bigint"), F.lit(0))

    # Texts of any equal length are compared 15 digits at a time, so that each piece fits in BIGINT.
    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(15))
    apart = F.aggregate(starts, F.lit(0), lambda sum_, at: sum_ + F.bit_count(piece(a, at).bitwiseXOR(piece(b, at))).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(HASH_BITS)).otherwise(apart).cast("int")


def bits_to_hex(bits: Column | str) -> Column:
    """Array of 64 zero/one values, first value = highest bit, to 16 hex characters."""
    packed = F.aggregate(
        _col(bits), F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("bigint"))
    )
    return long_to_hash(packed)


def block_hash(block: Column | str) -> Column:
    """Hash of an 8x8 coefficient block given as 64 values.

    A bit is set where the coefficient exceeds the mean of the 63 AC terms; the DC term is left out
    of the mean and keeps its own bit.
    """
    # One pass over a sum, then one over the bits: a singleton array binds the mean so the second
    # pass does not evaluate it again for every element.
    block = _col(block)
    total = F.aggregate(block, F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double"))
    mean = (total - F.element_at(block, 1).cast("double")) / F.lit(HASH_BITS - 1)
    packed = F.transform(
        F.array(mean),
        lambda m: F.aggregate(
            block,
            F.lit(0).cast("bigint"),
            lambda acc, v: F.shiftleft(acc, 1).bitwiseOR((v.cast("double") > m).cast("bigint")),
        ),
    )
    return long_to_hash(F.element_at(packed, 1))
