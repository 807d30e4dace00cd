"""Lemmas: a pluggable step. The default takes the lower-case word as its own lemma and makes no linguistic claim."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Makes the lemmatizer of a language: a function from words to lemmas.
Factory = Callable[[str], Callable[[list[str]], list[str]]]
_factories: list[Factory] = []
#: Fixed value: lists of words that a task has as Python strings at a time.
SLICE = 64
#: Fixed values for by_word(): words of whole lists that are looked at together, and how many different ones of them are Python strings at a time.
WORDS, STRINGS = 1 << 20, 1 << 14


def register_lemmatizer(factory: Factory) -> None:
    """Factories registered later are asked first; one that raises LookupError passes a language on."""
    _factories.insert(0, factory)


def by_word(lemma: Callable[[str], str]) -> Callable[[list[str]], list[str]]:
    """The lemmatizer of a function that gives a word its lemma whatever stands beside it: it is asked for different words only."""

    def call(words: list[str]) -> list[str]:
        return [lemma(w) for w in words]

    call.by_word = True
    return call


def _slices(rows: pa.Array) -> Iterator[pa.Array]:
    """Slices of lists with WORDS words at most, or one list."""
    ends, start = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
    while start < len(rows):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, "right")))
        yield rows.slice(start, end - start)
        start = end


def _lemmas_by_word(rows: pa.Array, call: Callable[[list[str]], list[str]]) -> pa.Array:
    """Lemmas of a slice of lists, each different word looked at once; nulls stay."""
    codes = rows.flatten().dictionary_encode()
    words = codes.dictionary
    lemmas = [pa.array(call(words.slice(i, STRINGS).to_pylist()), pa.string()) for i in range(0, len(words), STRINGS)]
    lemmas = pa.concat_arrays(lemmas) if lemmas else pa.array([], pa.string())
    ends = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), lemmas.take(codes.indices), mask=rows.is_null())


def _lemmas(rows: pa.Array, call: Callable[[list[str]], list[str]]) -> pa.Array:
    """Lemmas of a slice of lists; nulls stay, and Python has the strings of one slice only."""
    lists = [None if w is None else list(call(w)) for w in rows.to_pylist()]
    return pa.array(lists, pa.list_(pa.string()))


def lemmatize_with(lang: str, factories: list[Factory] | None = None) -> Callable[[Column], Column]:
    """A column function array<string> -> array<string> for one language. The lemmatizer is made once for each worker, when first needed."""
    chain = list(_factories if factories is None else factories)
    if not chain:
        return lambda words: F.transform(words, F.lower)

    @arrow_udf("array<string>")
    def lemmas(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = by_word(str.lower)
        for make in chain:
            try:
                call = make(lang)
                break
            except LookupError:
                continue
        for rows in batches:
            if getattr(call, "by_word", False):
                parts = [_lemmas_by_word(x, call) for x in _slices(rows)]
            else:
                parts = [_lemmas(rows.slice(i, SLICE), call) for i in range(0, len(rows), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return lambda words: lemmas(words)


def for_keywords(lemmas: Column) -> Column:
    """Lemmas of letters or digits only, of two characters or more."""
    return F.filter(lemmas, lambda x: x.rlike(r"^(\p{L}+|\p{Nd}+)$") & (F.char_length(x) > 1))


def for_coverage(lemmas: Column) -> Column:
    """Lower-case lemmas of letters only."""
    return F.filter(F.transform(lemmas, F.lower), lambda x: x.rlike(r"^\p{L}+$"))
