"""Tokenising mixed CJK and ASCII text into search terms: as column expressions, and for an index in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_TERMS = 24
_RUN = "([0-9A-Za-z]+|[一-鿿]+)"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(text: Column | str, nfkc: bool = True) -> Column:
    """NFKC, white space collapsed and cut off the ends. Spark has no function for NFKC; without it all stays in the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    if nfkc:
        text = _nfkc(text)
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _pieces(run: Column) -> Column:
    n = F.char_length(run)

    def grams(k: int) -> Column:
        # sequence(1, 0) counts down, so short runs are guarded
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(run, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    ascii_run = run.rlike("^[0-9A-Za-z]")
    whole = F.array(F.lower(run))
    return F.when(ascii_run | (n == 1), whole).when(n <= 4, F.concat(F.array(run), F.filter(F.concat(grams(2), grams(3)), lambda g: g != run))).otherwise(F.concat(grams(2), grams(3)))


def tokens(text: Column | str, nfkc: bool = False) -> Column:
    """Ordered distinct terms: ASCII runs in lower case; CJK runs as a whole (up to 4), in pairs and in threes.

    The text is one that was normalised before, as all of the search path is, unless NFKC is asked for.
    """
    runs = F.regexp_extract_all(normalize_text(text, nfkc), F.lit(_RUN), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, _pieces)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda own: None if own is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in own])


def _tags(tags: Column | str) -> Column:
    """Normalised tags that aren't blank."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.filter(F.transform(_nfkc_each(tags), lambda t: normalize_text(t, nfkc=False)), lambda t: t != "")


def tag_terms(tags: Column | str) -> Column:
    """For each tag the whole tag, then its tokens; ordered distinct."""
    each = F.transform(_tags(tags), lambda t: F.concat(F.array(F.lower(t)), tokens(t)))
    return F.array_distinct(F.flatten(each))


def caption_terms(tags: Column, description: Column, caption: Column) -> Column:
    """Whole tags, then the tokens of the description, then of the caption; ordered distinct."""
    return F.array_distinct(F.concat(F.transform(_tags(tags), F.lower), tokens(description, nfkc=True), tokens(caption, nfkc=True)))


def query_terms(text: Column | str, limit: int = QUERY_TERMS) -> Column:
    """The first tokens of a query; a query without any is one phrase; a blank one has no term."""
    whole = normalize_text(text)
    found = F.slice(tokens(whole), 1, limit)
    return F.when(F.size(found) > 0, found).when(whole != "", F.array(F.lower(whole))).otherwise(F.array().cast("array<string>"))


# ---- the same in Python, for whole documents at a time

_RUNS = re.compile(_RUN)


def plain(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").split())


def words(text: str) -> dict[str, None]:
    """``tokens`` of a plain text, as the keys of a dict in order."""
    out: dict[str, None] = {}
    for run in _RUNS.findall(text):
        n = len(run)
        if run[0] < "\x80":
            out[run.lower()] = None
        elif n == 1:
            out[run] = None
        else:
            if n <= 4:
                out[run] = None
            for k in (2, 3):
                for i in range(n - k + 1):
                    out[run[i : i + k]] = None
    return out


def field_terms(tags: list[str | None] | None, description: str | None, caption: str | None) -> tuple[list[str], list[str], list[str]]:
    """The terms of a document's three sparse fields; each text is normalised and read once."""
    own = [t for t in map(plain, tags or ()) if t]
    told, said = words(plain(description)), words(plain(caption))
    lower = [t.lower() for t in own]
    each = dict.fromkeys(x for t, w in zip(own, lower, strict=True) for x in (w, *words(t)))
    return list(each), list(told), list(dict.fromkeys([*lower, *told, *said]))
