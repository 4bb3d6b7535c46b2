"""Text expressions whose results do not depend on the platform's idea of white space."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPACES = " \t\n\r\f\v\u00a0" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u3000"


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space, Unicode spaces included."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(_SPACES))


def blank_to_null(c: Column | str) -> Column:
    """Stripped; empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Stripped, runs of white space made one space."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.translate(c, _SPACES, " " * len(_SPACES))
    return F.trim(F.when(plain.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain))


def squeeze_upper(c: Column | str) -> Column:
    """Squeezed, upper case."""
    return F.upper(squeeze(c))
