"""Character classes of tokens as a 6-bit mask, and which masks can hold a substring of a given mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit of each class; bytes of 128 and more fall into the last.
CLASSES = ((1, "[0-9]"), (2, "[A-F]"), (4, "[a-f]"), (8, "[G-Z]"), (16, "[g-z]"), (32, "[^0-9A-Za-z]"))


def type_mask(token: Column) -> Column:
    """OR over the classes of the token's characters; 0 for the empty string, null for null."""
    return sum((F.when(token.rlike(p), bit).otherwise(0) for bit, p in CLASSES[1:]), F.when(token.rlike(CLASSES[0][1]), 1).when(token.isNotNull(), 0))


def mask_of(text: str) -> int:
    """The same for a string on the driver."""
    mask = 0
    for c in text:
        mask |= 1 if "0" <= c <= "9" else 2 if "A" <= c <= "F" else 4 if "a" <= c <= "f" else 8 if "G" <= c <= "Z" else 16 if "g" <= c <= "z" else 32
    return mask


def supersets(mask: int) -> list[int]:
    """Masks 1..63 that contain all classes of ``mask``: the only types in which a substring of that mask can occur."""
    return [t for t in range(1, 64) if t & mask == mask]
