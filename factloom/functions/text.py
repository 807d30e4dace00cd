"""Column functions on texts, titles and URLs. Built-ins only, but for normalize_text()."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WORD = r"([\p{L}\p{N}_]+)"
_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def percent_decode(c: Column | str) -> Column:
    """Percent escapes decoded; a plus stays a plus, and a percent sign without two hexadecimal digits stays as it is."""
    c = F.col(c) if isinstance(c, str) else c
    escaped = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(escaped), c)


def absolute_url(page: Column, href: Column) -> Column:
    """Scheme and host of the page before a link that begins at the root."""
    return F.concat(F.regexp_extract(page, r"^(https?://[^/]+)", 1), href)


def article_key(url: Column) -> tuple[Column, Column]:
    """Language and title of an article URL; both null if the URL is of another kind."""
    plain = percent_decode(url)
    pattern = r"^https?://([a-z]{2})\.wikipedia\.org/wiki/(.+)"
    return tuple(F.when(F.regexp_like(plain, F.lit(pattern)), F.regexp_extract(plain, pattern, i)) for i in (1, 2))


def title_of(url: Column | str) -> Column:
    """What stands between the first and the second /wiki/, null without any."""
    c = F.col(url) if isinstance(url, str) else url
    return F.when(F.contains(c, F.lit("/wiki/")), F.split_part(c, F.lit("/wiki/"), F.lit(2)))


def spoken_title(url: Column | str) -> Column:
    """The title with escapes decoded and underscores as spaces."""
    return F.replace(percent_decode(title_of(url)), F.lit("_"), F.lit(" "))


def words(c: Column | str) -> Column:
    """Distinct lower-case words in code-point order."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1))))


def nonbreaking_to_space(c: Column | str) -> Column:
    return F.translate(c, "\u00a0", " ")


def abstract(c: Column | str) -> Column:
    """Text before the first blank line."""
    c = F.col(c) if isinstance(c, str) else c
    return F.split_part(c, F.lit("\n\n"), F.lit(1))


def paragraphs(c: Column | str) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def sentences(c: Column | str) -> Column:
    """Parts that end with . ! or ? before white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def fragments(c: Column | str, splitter="sentence", lang: str = "en") -> Column:
    """Parts of a text: ``sentence`` by a pattern, ``paragraph``, or sentences by learned boundaries (functions/sentences.py) of a language."""
    if hasattr(splitter, "sentences"):
        return splitter.split(c, F.lit(lang))
    if splitter not in ("sentence", "paragraph"):
        raise ValueError(f"no splitter is called {splitter}")
    return sentences(c) if splitter == "sentence" else paragraphs(c)


#: Letters of Western European texts and what is left of them without marks.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
UNMARKED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def unaccented(c: Column | str) -> Column:
    """Without the marks of Western European letters, inside generated code; normalize_text() does any alphabet."""
    return F.translate(c, MARKED, UNMARKED)


#: Lower-case letters whose mark makes them another letter; the stressed vowel; heading marks.
KEPT_LETTERS, STRESSED, HEADING = "йё", ("\u0430\u0301", "\u0430"), re.compile(r"==\s*(.*?)\s*==\s*")


def normalized(text: str) -> str:
    """Heading marks and diacritics removed, non-breaking spaces replaced, composed; й and ё stay, their capitals don't."""
    text = HEADING.sub(lambda m: m[1] + " ", text.replace(*STRESSED)).replace("\u00a0", " ").strip()
    if text.isascii():
        return text
    runs = re.split(f"([{KEPT_LETTERS}]+)", unicodedata.normalize("NFC", text))
    # every second run is of kept letters
    runs[::2] = ["".join(x for x in unicodedata.normalize("NFD", r) if not unicodedata.combining(x)) for r in runs[::2]]
    return "".join(runs)


@pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    return texts.map(normalized, na_action="ignore")
