"""Sentences by boundaries learned from texts: which words end with a period that ends nothing is told by how often they have one."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Chance that an abbreviation has its period; least score of an abbreviation, least log-likelihood ratios of a word that begins
#: sentences and of two words that belong together.
ALWAYS, ABBREVIATION, STARTER, TOGETHER = 0.99, 0.3, 30.0, 7.88
#: Entries of each kind and language that a model has at most, the best ones; more than any language is known to have.
LIMIT = 20_000
#: Parts of a language whose best entries are found apart.
PARTS = 64
#: A word, and what stands around it.
TOKEN, AROUND = r"[^\x20\x09-\x0D]+", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
_CLOSING = "“\"'”’»)]}"
_SPACE = " \t\n\v\f\r"
#: Where a sentence may end: a mark at the end of a token; and the token after it.
_END, _NEXT = re.compile(rf"[.!?…][{re.escape(_CLOSING)}]*(?![^\x20\x09-\x0D])"), re.compile(rf"[\x20\x09-\x0D]*({TOKEN})")


def _bare(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(c), AROUND, "")


def _word_of(bare: str) -> Column:
    word = F.regexp_replace(bare, r"\.$", "")
    return F.when(word.rlike(r"^[0-9]+$"), "0").otherwise(word)


def _found(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, t): the tokens of each text as they stand there."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    return docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), found.alias("t"))


def _followed(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, t, n): each token as it stands there and the one after it."""
    after = F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))
    rows = _found(docs, lang, text).select("lang", F.explode(F.arrays_zip(F.col("t").alias("t"), after.alias("n"))).alias("x"))
    return rows.select("lang", "x.t", "x.n")


def tokens(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, period, next): each token in lower case without what stands around it and without its last period, whether it has one, and
    the token after it; a token of digits only is the word ``0``. Null texts have none; a null language is the empty string."""
    rows = _followed(docs, lang, text).select("lang", _bare("t").alias("b"), F.regexp_replace(_bare("n"), r"\.$", "").alias("next"))
    return rows.where("b <> ''").select("lang", _word_of("b").alias("word"), F.col("b").endswith(".").alias("period"), "next")


def token_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, period, k): how often tokens() has each word with and without its period. Tokens are counted as they stand in the texts,
    and only different ones are looked at."""
    counts = _found(docs, lang, text).select("lang", F.explode("t").alias("t")).groupBy("lang", "t").agg(F.count(F.lit(1)).alias("k"))
    rows = counts.select("lang", _bare("t").alias("b"), "k").where("b <> ''")
    return rows.select("lang", _word_of("b").alias("word"), F.col("b").endswith(".").alias("period"), "k")


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the chance of k in n under p, but for a factor; p is kept off 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def abbreviation_scores(words: DataFrame) -> DataFrame:
    """tokens() or token_counts() -> (lang, word, with_period, without, score) of words that have a letter and a period at least once.

    The score is the log-likelihood ratio of ``the period is nearly always there`` against ``it is as frequent as with any word``, less for
    longer words and for each time the word stands without a period, more for each period inside. Counts are summed before they are moved.
    """
    from ..sources.storage import stored

    k = F.col("k") if "k" in words.columns else F.lit(1).cast("long")
    counts = words.groupBy("lang", "word").agg(F.sum(F.when(F.col("period"), k).otherwise(0)).alias("with_period"), F.sum(F.when(F.col("period"), 0).otherwise(k)).alias("without"))
    counts = stored(counts, "words")
    every = counts.groupBy("lang").agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without")).alias("n"))
    rows = counts.where("with_period > 0").where(F.col("word").rlike(r"\p{L}")).join(F.broadcast(every), "lang")  # a row for each language
    k, n = F.col("with_period").cast("double"), (F.col("with_period") + F.col("without")).cast("double")
    ratio = 2 * (_likelihood(k, n, F.lit(ALWAYS)) - _likelihood(k, n, F.col("periods") / F.col("n")))
    inside = F.char_length("word") - F.char_length(F.replace("word", F.lit("."), F.lit("")))
    length = F.char_length("word") - inside
    score = ratio * F.exp(-length.cast("double")) * (inside + 1) * F.pow(F.greatest(length, F.lit(1)).cast("double"), -F.col("without").cast("double"))
    return rows.select("lang", "word", "with_period", "without", score.alias("score"))


def _best(rows: DataFrame, *columns: str, limit: int) -> list[tuple]:
    """The best rows of each language: of parts of it first, so that no task sorts a whole language."""
    from pyspark.sql import Window as W

    order = [F.desc("score"), *columns]
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(PARTS)))
    parts = parts.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_n") <= limit)
    best = parts.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= limit)
    return [tuple(r) for r in best.select("lang", *columns).collect()]


def _associated(pairs: DataFrame, least: float) -> DataFrame:
    """(..., both, first, second, n) -> those rows that stand together more often than by chance, with the log-likelihood ratio as score."""
    both, first, second, n = (F.col(c).cast("double") for c in ("both", "first", "second", "n"))
    p, p1, p2 = second / n, both / first, (second - both) / F.greatest(n - first, F.lit(1.0))
    score = 2 * (_likelihood(both, first, p1) + _likelihood(second - both, n - first, p2) - _likelihood(both, first, p) - _likelihood(second - both, n - first, p))
    return pairs.withColumn("score", score).where((F.col("score") >= least) & (p1 > p))


def _pairs(docs: DataFrame, short: list[tuple], lang: str, text: str) -> DataFrame:
    """(lang, word, next, k): how often ``next`` follows a word. The word is null if it has no period, empty if its period ends a sentence, and
    itself if it is an abbreviation of ``short``, a letter or a number: only pairs of these are told apart. Tokens that follow are counted as
    they stand in the texts; of the others only those with a period in them are looked at closely."""
    known = F.broadcast(docs.sparkSession.createDataFrame(short, "lang string, word string").withColumn("short", F.lit(True)))
    rows = _followed(docs, lang, text).where("n is not null").where(F.col("t").rlike(r"[\p{L}\p{N}]"))
    rows = rows.select("lang", "n", F.when(F.contains("t", F.lit(".")), _bare("t")).alias("b"))
    rows = rows.select("lang", "n", F.when(F.col("b").endswith("."), _word_of("b")).alias("word")).join(known, ["lang", "word"], "left")
    kept = F.when(F.coalesce("short", F.char_length("word") == 1), F.col("word")).otherwise(F.when(F.col("word").isNotNull(), ""))
    counts = rows.select("lang", kept.alias("word"), "n").groupBy("lang", "word", "n").agg(F.count(F.lit(1)).alias("k"))
    return counts.select("lang", "word", F.regexp_replace(_bare("n"), r"\.$", "").alias("next"), "k").groupBy("lang", "word", "next").agg(F.sum("k").alias("k"))


def learn_boundaries(docs: DataFrame, lang: str = "lang", text: str = "text", limit: int = LIMIT) -> Boundaries:
    """A model for each language of ``docs``, from counts over all of its texts. Only the model, at most ``limit`` entries of a kind and
    language, comes to the driver."""
    from ..sources.storage import stored

    scores = abbreviation_scores(token_counts(docs, lang, text)).where(F.col("score") >= ABBREVIATION)
    short = _best(scores, "word", limit=limit)
    pairs = stored(_pairs(docs, short, lang, text), "pairs")
    n = pairs.groupBy("lang").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("word") == "", F.col("k")).otherwise(0)).alias("first"))
    # begins sentences: stands after a period that ends one more often than elsewhere
    after = pairs.groupBy("lang", "next").agg(F.sum("k").alias("second"), F.sum(F.when(F.col("word") == "", F.col("k")).otherwise(0)).alias("both"))
    starters = _best(_associated(after.join(F.broadcast(n), "lang").where("both > 0"), STARTER).where(F.col("next").rlike(r"\p{L}")), "next", limit=limit)
    # belong together across a period: an abbreviation, a letter or a number, and what mostly follows it
    held = pairs.where("word <> ''")
    firsts = held.groupBy("lang", "word").agg(F.sum("k").alias("first"))
    held = held.select("lang", "word", "next", F.col("k").alias("both")).where("both > 1")
    held = held.join(firsts, ["lang", "word"]).join(after.select("lang", "next", "second"), ["lang", "next"]).join(F.broadcast(n.select("lang", "n")), "lang")
    together = _best(_associated(held, TOGETHER), "word", "next", limit=limit)
    return Boundaries(frozenset(short), frozenset(starters), frozenset(together))


@dataclass(frozen=True)
class Boundaries:
    """Abbreviations (lang, word), words that begin sentences (lang, word), and pairs across a period (lang, word, next)."""

    abbreviations: frozenset
    starters: frozenset
    together: frozenset

    def ends(self, lang: str, token: str, following: str | None) -> bool:
        """Whether a sentence ends after a token."""
        bare = token.rstrip(_CLOSING)
        if bare.endswith(("!", "?", "…")) or following is None:
            return True
        if not bare.endswith("."):
            return False
        word, after = _word(bare), _word(following)
        if word.isdigit():
            return not (following[:1].islower() or (lang, "0", after) in self.together)
        if (lang, word) in self.abbreviations or len(word) == 1 and word.isalpha():
            return following[:1].isupper() and (lang, after) in self.starters and (lang, word, after) not in self.together
        return True

    def sentences(self, text: str | None, lang: str | None) -> list[str]:
        text, out, start = text or "", [], 0
        for m in _END.finditer(text):
            after = _NEXT.match(text, m.end())
            at = m.start()
            if text[at] == ".":
                while at > start and text[at - 1] not in _SPACE:
                    at -= 1
            if self.ends(lang or "", text[at : m.end()], after and after[1]):
                out.append(text[start : m.end()].strip())
                start = m.end()
        out.append(text[start:].strip())
        return [s for s in out if s]

    def split(self, text: Column | str, lang: Column | str) -> Column:
        """Sentences of a text in a language: array<string>."""

        @pandas_udf("array<string>")
        def sentences(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for texts, langs in batches:
                yield pd.Series([self.sentences(t, g) for t, g in zip(texts, langs, strict=True)], index=texts.index)

        return sentences(text, lang)


@functools.lru_cache(1 << 16)
def _word(token: str) -> str:
    return re.sub(r"^[\W_]+|[^\w.]+$", "", token.lower()).removesuffix(".")
