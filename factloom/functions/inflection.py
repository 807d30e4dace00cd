"""Lemmas by edit rules that are induced from pairs of a form and its lemma: what to cut off and what to put in its place, by the form's ending."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lemmas import by_word

#: Characters of an ending that rules look at, and what stands before a form's first character.
ENDING, EDGE = 8, "^"
#: An ending that is not a whole form has a rule if so many forms, and this share of its forms, ask for it.
FORMS, SHARE = 2, 0.5
#: Rules of a language that a model has at most, those most asked for; a lexicon of irregular forms is within it.
LIMIT = 200_000


def edits(pairs: DataFrame) -> DataFrame:
    """pairs (lang, form, lemma) -> (lang, form, cut, put): in lower case, what differs behind what both begin with. Pairs with a null or an
    empty form are left out; equal pairs count once."""
    rows = pairs.where("form is not null and form <> '' and lemma is not null").select("lang", F.lower("form").alias("form"), F.lower("lemma").alias("lemma")).distinct()
    n = F.least(F.char_length("form"), F.char_length("lemma"))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr("form", i, F.lit(1)) == F.substr("lemma", i, F.lit(1)))
    differ = F.array_position(F.concat(same, F.array(F.lit(False))), False)
    shared = F.when(F.startswith("form", "lemma"), n).otherwise(differ - 1).cast("int")
    return rows.select("lang", "form", (F.char_length("form") - shared).alias("cut"), F.substr("lemma", shared + 1).alias("put"))


def ending_counts(edited: DataFrame, longest: int = ENDING, whole: bool = True) -> DataFrame:
    """edits() -> (lang, ending, cut, put, forms): how many forms with an ending ask for an edit. Endings go from none to ``longest``
    characters, and to the ``whole`` form behind an edge; a count is summed before it is moved."""
    size = F.char_length("form")
    parts = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(longest))), lambda i: F.substr("form", size - i + 1))
    endings = F.concat(parts, F.array(F.concat(F.lit(EDGE), F.col("form")))) if whole else parts
    return edited.select("lang", F.explode(endings).alias("ending"), "cut", "put").groupBy("lang", "ending", "cut", "put").agg(F.count(F.lit(1)).alias("forms"))


def _kept(counts: DataFrame, forms: int, share: float) -> DataFrame:
    """ending_counts() -> (lang, ending, cut, put, forms), the edit of each ending that has enough forms."""
    best = counts.groupBy("lang", "ending").agg(F.min(F.struct((-F.col("forms")).alias("order"), "cut", "put")).alias("b"), F.sum("forms").alias("all"))
    best = best.select("lang", "ending", "b.cut", "b.put", (-F.col("b.order")).alias("forms"), "all")
    kept = best.where(F.col("ending").startswith(EDGE) | (F.col("forms") >= forms) & (F.col("forms") >= F.col("all") * share) & (F.col("cut") <= F.char_length("ending")))
    return kept.drop("all")


def _new(kept: DataFrame, shorter: DataFrame) -> DataFrame:
    """Rules that say something else than that of the ending without its first character."""
    shorter = shorter.select("lang", F.col("ending").alias("_short"), F.col("cut").alias("_cut"), F.col("put").alias("_put"))
    # a whole form follows from the form's longest ending, others from the ending that is shorter by one
    tail = F.when(F.col("ending").startswith(EDGE), F.substr("ending", F.greatest(F.char_length("ending") - ENDING + 1, F.lit(2)))).otherwise(F.substr("ending", F.lit(2)))
    joined = kept.withColumn("_short", F.when(F.col("ending") != "", tail)).join(shorter, ["lang", "_short"], "left")
    return joined.where("_cut is null or _cut <> cut or _put <> put").select("lang", "ending", "cut", "put", "forms")


def rules(counts: DataFrame, forms: int = FORMS, share: float = SHARE) -> DataFrame:
    """ending_counts() -> (lang, ending, cut, put, forms), the edit that most forms of an ending ask for; ties go to the shorter cut, then by
    code point. A rule needs ``forms`` forms and a ``share`` of all with its ending, or a whole form; one that the ending without its first
    character has too is left out, as it says nothing new. What is cut has to be part of the ending."""
    kept = _kept(counts, forms, share)
    return _new(kept, kept)


def learned_rules(edited: DataFrame) -> DataFrame:
    """edits() -> rules(), without a count for each whole form: a form asks for each of its edits once. Counts of endings are stored."""
    from ..sources.storage import stored

    counts = ending_counts(edited, whole=False)
    ends = stored(_kept(counts, FORMS, SHARE).where(~F.col("ending").startswith(EDGE)), "endings")
    whole = edited.groupBy("lang", "form").agg(F.min(F.struct("cut", "put")).alias("b"))
    whole = whole.select("lang", F.concat(F.lit(EDGE), F.col("form")).alias("ending"), "b.cut", "b.put", F.lit(1).cast("long").alias("forms"))
    return _new(ends.unionByName(whole), ends)


def script_of(word: str) -> str:
    """The script of the first letter, by the beginning of its name."""
    return next((unicodedata.name(c, "").split(" ")[0] for c in word if c.isalpha()), "")


@dataclass(eq=False)
class Lemmas:
    """Rules by their endings, a table for each language and one for each script, made of all languages written in it, and how long the
    endings of each table are, longest first."""

    tables: dict[str, dict[str, tuple[int, str]]] = field(default_factory=dict)
    lengths: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple]) -> Lemmas:
        """rows (lang or script, ending, cut, put)."""
        out = cls()
        for lang, ending, cut, put in rows:
            out.tables.setdefault(lang, {})[ending] = cut, put
        for lang, table in out.tables.items():
            out.lengths[lang] = sorted({len(e) for e in table if e and not e.startswith(EDGE)}, reverse=True)
        return out

    def lemma(self, word: str, lang: str) -> str:
        """The ladder: rules of the language, else those of the word's script, else the word itself, in lower case."""
        word = word.lower()
        name = lang if lang in self.tables else f"script:{script_of(word)}"
        if name not in self.tables:
            return word
        cut, put = self._rule(name, word)
        return word[: len(word) - cut] + put

    def _rule(self, name: str, word: str) -> tuple[int, str]:
        """That of the whole form, else of the longest ending which leaves something of the word."""
        table, n = self.tables[name], len(word)
        rule = table.get(EDGE + word)
        if rule:
            return rule
        for i in self.lengths[name]:
            rule = table.get(word[n - i :]) if i <= n else None
            if rule and rule[0] < n:
                return rule
        rule = table.get("", (0, ""))
        return rule if rule[0] <= n else (0, "")

    def factory(self) -> Callable[[str], Callable[[list[str]], list[str]]]:
        """For register_lemmatizer() or lemmatize_with(): LookupError where neither language nor any script has rules."""

        def make(lang: str) -> Callable[[list[str]], list[str]]:
            if lang not in self.tables and not any(n.startswith("script:") for n in self.tables):
                raise LookupError(lang)
            return by_word(lambda word: self.lemma(word, lang))

        return make


def learn_lemmas(pairs: DataFrame, limit: int = LIMIT) -> Lemmas:
    """A model of pairs (lang, form, lemma), however many; at most ``limit`` rules of a language come to the driver. Pairs and their edits are
    stored, as they are read more than once.

    Pairs may come from any lexicon of forms. Languages without pairs use what all languages of their script share."""
    from pyspark.sql import Window as W

    from ..sources.storage import stored

    pairs = stored(pairs.select("lang", "form", "lemma"), "pairs")
    first = F.regexp_extract("form", r"(\p{L})", 1)
    letters = [r[0] for r in pairs.select(first).where(first != "").distinct().collect()]  # letters of alphabets, not of data
    names = F.create_map(*(x for c in letters for x in (F.lit(c), F.lit(f"script:{script_of(c)}")))) if letters else F.lit(None)
    by_script = pairs.select(F.element_at(names, first).alias("lang") if letters else F.lit("").alias("lang"), "form", "lemma").where("lang is not null")
    found = learned_rules(stored(edits(pairs.unionByName(by_script)), "edits"))
    order = W.partitionBy("lang").orderBy(F.desc("forms"), "ending")
    rows = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("lang", "ending", "cut", "put").collect()
    return Lemmas.of([tuple(r) for r in rows])
