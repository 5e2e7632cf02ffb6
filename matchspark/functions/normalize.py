"""Normal forms of names, and the key that finds the same posting on two boards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal-form suffixes of company names.
COMPANY_SUFFIXES = (
    "inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "pvt", "private", "plc", "corp", "corporation", "co", "company", "gmbh", "mbh",
    "ag", "bv", "nv", "sa", "sas", "sarl", "srl", "spa", "pte", "pty", "oy", "ab", "as", "kk", "sdn", "bhd",
)


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKD").str.casefold()


def _squeezed(folded: Column) -> Column:
    spaced = F.regexp_replace(folded, r"[-/_]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]", ""), r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))


def normalize_text(value: Column, unicode: bool = True) -> Column:
    """Case and punctuation folded away, one space between words; null: empty.

    ASCII rows stay in generated code. Other rows need compatibility
    decomposition and case folding, which Spark lacks, so they take an Arrow
    function; ``unicode=False`` leaves it out for input known to be ASCII.
    """
    value = F.coalesce(value, F.lit(""))
    if not unicode:
        return _squeezed(F.lower(value))
    odd = value.rlike(r"[^\x00-\x7F]")
    return _squeezed(F.when(odd, _fold(F.when(odd, value))).otherwise(F.lower(value)))


def normalize_company(value: Column, unicode: bool = True) -> Column:
    """normalize_text without legal suffixes at the end, but never without its first word."""
    return F.regexp_replace(normalize_text(value, unicode), r"^(\S+(?: \S+)*?)(?: (?:" + "|".join(COMPANY_SUFFIXES) + r"))+$", "$1")


def extract_city(location: Column) -> Column:
    """What stands before the first comma."""
    return F.trim(F.substring_index(F.coalesce(location, F.lit("")), ",", 1))


def dedup_hash(company: Column, title: Column, city: Column, unicode: bool = True) -> Column:
    """SHA-256 of the three normal forms, divided by NUL."""
    return F.sha2(F.concat_ws("\0", normalize_company(company, unicode), normalize_text(title, unicode), normalize_text(city, unicode)), 256)


def job_id(source: Column, source_job_id: Column) -> Column:
    """An id that does not change when a posting is read again."""
    return F.sha2(F.concat_ws("\0", source, source_job_id), 256)
