"""Cell and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitude suffixes and their factors, longest first.
MAGNITUDES = (("万亿", 1e12), ("亿", 1e8), ("万", 1e4), ("千", 1e3), ("百", 1e2))
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_junk(cell: Column) -> Column:
    """Null, blank, or a generated header name."""
    return cell.isNull() | (F.trim(cell) == "") | cell.rlike(r"(?i)^\s*Unnamed:\s*\d+\s*$")


def number(cell: Column) -> Column:
    """A cell as a double: thousands separators dropped, a last % divides by 100; null if it is no number."""
    bare = F.regexp_replace(F.trim(cell), "[,%]", "")
    value = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    return F.when(F.endswith(F.trim(cell), F.lit("%")), value / 100).otherwise(value)


def magnitude(text: Column) -> Column:
    """A number with an optional magnitude suffix; % is dropped, not scaled."""
    bare = F.regexp_replace(F.trim(text), "[,%\\s]", "")
    out = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    for suffix, factor in reversed(MAGNITUDES):
        head = F.regexp_replace(bare, suffix + "$", "")
        out = F.when(F.endswith(bare, F.lit(suffix)) & head.rlike(_NUMBER), head.try_cast("double") * factor).otherwise(out)
    return out


def numbers_in(text: Column) -> Column:
    """Distinct number tokens of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1))


def full_to_half(text: Column) -> Column:
    """Full-width ASCII forms to plain ones."""
    return F.translate(text, "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　", "".join(chr(c) for c in range(0x21, 0x7F)) + " ")
