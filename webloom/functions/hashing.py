"""Digests and SimHash as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def token_bits(term: Column) -> Column:
    """The first 64 bits of the MD5 of a term as an array of 0 and 1."""
    return F.split(F.lpad(F.conv(F.substring(F.md5(term), 1, 16), 16, 2), 64, "0"), "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
