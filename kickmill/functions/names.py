"""Normal forms of team names, and their similarity."""

from __future__ import annotations

import difflib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: str) -> str:
    """Accents off, lower case, punctuation as spaces, single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", plain.lower()).split())


def normalized(name: Column) -> Column:
    """``normal_name`` of a column; JVM-side where the text is ASCII."""

    @F.pandas_udf("string")
    def by_python(names):
        return names.map(lambda x: None if x is None else normal_name(x))

    ascii_only = F.octet_length(name) == F.char_length(name)
    quick = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_\s]", " "), r"\s+", " "))
    return F.when(ascii_only, quick).otherwise(by_python(F.when(~ascii_only, name)))


def closest(name: str, pool: list[str], cutoff: float = 0.92) -> tuple[str, float] | None:
    """The most similar known name at or above the cutoff, and the similarity that is recorded."""
    found = difflib.get_close_matches(name, pool, n=1, cutoff=cutoff)
    # the search compares (candidate, name), the record (name, candidate): the measure isn't symmetric
    return (found[0], round(difflib.SequenceMatcher(None, name, found[0]).ratio(), 4)) if found else None
