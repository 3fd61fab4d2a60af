"""Normal forms and learning folds that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes: A-Z to lower case, ASCII punctuation and white space to a blank, all else as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    """Lower case, with every run of ASCII punctuation and white space as one blank; null is empty."""
    return b" ".join((text or "").lower().encode().translate(FOLD).split())


def held_out(id_col: str) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
