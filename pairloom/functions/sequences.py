"""Column functions on sequences, reads and region strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def gc_fraction(s: Column) -> Column:
    """Share of G and C among all letters; null for an empty string."""
    return F.length(F.regexp_replace(F.upper(s), "[^GC]", "")) / F.nullif(F.length(s), F.lit(0))


def subsequence(s: Column, start: Column, end: Column) -> Column:
    """Letters start..end, 1-based and inclusive."""
    return F.substr(s, start, end - start + 1)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgtNn", "TGCAtgcaNn"))


def read_name(name: Column) -> Column:
    """A read's name without mate suffix and comment."""
    return F.regexp_extract(name, r"^@?(\S+?)(?:/[12])?(?:\s.*)?$", 1)


def trimmed(s: Column, step: int, front: bool = False) -> Column:
    """A read shortened by step letters at its end, or at its front."""
    n = F.greatest(F.length(s) - step, F.lit(0))
    return F.substr(s, F.lit(1 + step if front else 1), n)


def split_at_junction(s: Column, junction: str, site: str) -> Column:
    """Parts of a read at its ligation junctions; each keeps its half of the restriction site."""
    keep = len(junction) // 2
    return F.split(s, f"(?<=(?={junction}).{{0}})(?!^)" if not keep else f"(?<={junction[:keep]})(?={junction[keep:]})", -1)


def cigar_matched(cigar: Column) -> Column:
    """Letters that a CIGAR string matches (M, = and X)."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)[M=X]"), F.lit(1))
    return F.aggregate(n, F.lit(0), lambda s, x: s + x.cast("int"))


def natural_key(s: Column, width: int = 20) -> Column:
    """A key whose order is natural: runs of digits compare as numbers."""
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def log_or(x: Column, base: float = 2.0, default: float | None = None) -> Column:
    """Logarithm, or a default where it is not finite."""
    return F.when(x > 0, F.log(base, x)).otherwise(F.lit(default))


def lambda_chunk(x: Column) -> Column:
    """Bin of an expected value on a scale of cube roots of two."""
    return F.when(x > 0, F.greatest(F.lit(0), F.floor(F.abs(3 * F.log2(x))) * F.signum(F.log2(x)) + 1)).cast("int")


_REGION = re.compile(r"^([^:]+)(?::([\d,.]+[kKmMgG]?[bB]?)?-([\d,.]+[kKmMgG]?[bB]?)?(?::([+-]|-?1))?)?$")


def bases(text: str) -> int:
    """"1mb", "500kb", "1,000" as a number of bases."""
    m = re.fullmatch(r"([\d,.]+)\s*([kKmMgG]?)[bB]?", text.strip())
    if not m:
        raise ValueError(f"not a number of bases: {text!r}")
    return int(float(m[1].replace(",", "")) * {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[m[2].lower()])


def human(n: float) -> str:
    """A number of bases with a unit."""
    for unit, size in (("gb", 10**9), ("mb", 10**6), ("kb", 10**3)):
        if abs(n) >= size:
            return f"{n / size:g}{unit}"
    return f"{n:g}b"


def parse_region(text: str) -> tuple[str, int | None, int | None, int | None]:
    """(chromosome, start, end, strand) of ``chr:start-end[:strand]``."""
    m = _REGION.match(text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    strand = {"+": 1, "1": 1, "-": -1, "-1": -1, None: None}[m[4]]
    return m[1], bases(m[2]) if m[2] else None, bases(m[3]) if m[3] else None, strand
