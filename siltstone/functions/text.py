"""Column expressions for text: tokens, the text to index, previews. All stay on the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of these after lower-casing.
TOKEN = "[a-z0-9]+"
Tokenizer = Callable[[Column], Column]


def tokens(text: Column) -> Column:
    """array<string> of the tokens in order, with repeats; null and token-free texts give an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def query_tokens(query: str | None) -> list[str]:
    """The same for a query on the driver."""
    return re.findall(TOKEN, (query or "").lower())


def body(*fields: str, pandas_nulls: bool = False) -> Column:
    """The text to index: the fields with a space between. A missing one is empty, or the word ``nan`` as pandas has it."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("nan" if pandas_nulls else "")) for f in fields]
    return F.concat_ws(" ", *parts)


def preview(text: Column, chars: int = 150) -> Column:
    """The first characters, and three dots if there are more."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stop_words_removed(toks: Column, words: list[str]) -> Column:
    """Extension: tokens that are not in a list, with their order and repeats."""
    return F.filter(toks, lambda t: ~t.isin(list(words))) if words else toks


def tokenizer(stop_words: list[str] | None = None, alphabetic: bool = False, least: int = 1, stem: Callable[[Column], Column] | None = None) -> Tokenizer:
    """Extension: a tokenizer with options, to be given to an index. ``alphabetic`` keeps tokens of letters alone,
    ``least`` those of so many characters; ``stem`` maps the remaining tokens, one by one."""

    def run(text: Column) -> Column:
        toks = stop_words_removed(tokens(text), stop_words or [])
        if alphabetic:
            toks = F.filter(toks, lambda t: ~t.rlike("[0-9]"))
        if least > 1:
            toks = F.filter(toks, lambda t: F.length(t) >= least)
        return F.transform(toks, stem) if stem else toks

    return run


def term_key(term: Column) -> Column:
    """A name for a term that is safe in paths: the md5 of its UTF-8, in hex."""
    return F.md5(term.cast("binary"))
