"""Sequence columns: bases, complements, slices, codes and names, all JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 64 printable state characters: fixed alphabet, in code order.
STATE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Context codes: fixed values (CG, CHG, CHH on the forward and on the reverse strand).
CONTEXTS = {"CG": (1, 9), "CHG": (3, 11), "CHH": (7, 15)}


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTN", "TGCAN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def piece(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end), 0-based; cut as bytes, as a cut of a string walks all characters before it."""
    return F.substring(seq.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def count_of(seq: Column, bases: str) -> Column:
    """How many characters of ``seq`` are among ``bases``."""
    return (F.length(seq) - F.length(F.translate(seq, bases, ""))).cast("long")


def gc_bin(gc: Column, length: Column, bins: int) -> Column:
    """The nearest of ``bins`` bins of gc / length, halves up, in integers."""
    scaled = gc * (bins - 1)
    return (F.floor(scaled / length) + F.when((scaled % length) * 2 >= length, 1).otherwise(0)).cast("long")


def context_class(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (plus, minus) in CONTEXTS.items():
        out = F.when(code.isin(plus, minus), name).otherwise(out)
    return out


def context_code(near: Column) -> Column:
    """The code at the middle of five bases (blanks beyond an end), null where undefined."""
    code = F.lit(None).cast("int")
    for pattern, value in (("^..CG", 1), ("^..C[ACT]G", 3), ("^..C[ACT][ACT]", 7), ("^.CG", 9), ("^C[AGT]G", 11), ("^[AGT][AGT]G", 15)):
        code = F.when(near.rlike(pattern) & code.isNull(), F.lit(value)).otherwise(code)
    return code


def site_entity(kind: Column, payload: Column) -> Column:
    """A 4-bit kind over a 60-bit payload."""
    return F.shiftleft(kind.cast("long"), 60).bitwiseOR(payload.cast("long"))


def site_parts(entity: Column) -> tuple[Column, Column]:
    """(kind, payload) of an entity."""
    return F.shiftrightunsigned(entity, 60), entity.bitwiseAND(F.lit((1 << 60) - 1))


def read_name(contig: Column, start: Column, end: Column, ordinal: Column) -> Column:
    """contig:start-end:ordinal, 1-based, the ordinal in hexadecimal."""
    return F.concat_ws(":", contig, F.concat_ws("-", (start + 1).cast("string"), F.greatest(end, start + 1).cast("string")), F.lower(F.hex(ordinal)))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def phred_text(quality: Column) -> Column:
    return F.char(quality + 33)
