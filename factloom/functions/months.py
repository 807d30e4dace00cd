"""Months and dates in section titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Month names by language, January first.
MONTHS = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    "de": ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"],
    "fr": ["Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"],
    "pt": ["Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro"],
    "ru": ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь"],
}


def month_dimension(spark: SparkSession) -> DataFrame:
    """(lang, number, name): sixty rows, small enough to be sent to every task."""
    return spark.createDataFrame([(g, i, n) for g, names in MONTHS.items() for i, n in enumerate(names, 1)], "lang string, number int, name string")


def month_number(name: Column) -> Column:
    """Number of a month name in any of the languages, whatever its case; null if there is none."""
    wanted = F.lower(F.trim(name))
    table = {n.lower(): i for names in MONTHS.values() for i, n in enumerate(names, 1)}
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), wanted)


def fact_month(year: Column, month: Column) -> Column:
    """``YYYY-MM``, or null where the month can't be read."""
    n = month_number(month)
    return F.when(n.isNotNull() & year.rlike(r"^\d{4}$"), F.concat_ws("-", year, F.lpad(n.cast("string"), 2, "0")))


def _any_case(names: list[str]) -> str:
    return "(?iu)(" + "|".join(names) + ")"


def _canonical(name: Column, lang: str) -> Column:
    return reduce(lambda rest, n: F.when(F.lower(name) == n.lower(), F.lit(n)).otherwise(rest), reversed(MONTHS[lang]), F.lit(None).cast("string"))


def french_section_date(note: Column) -> Column:
    """``DD Month YYYY`` from a note: from an ISO date if there is one (null if its month isn't one), else from a day, a month's name and a year."""
    iso = r"(\d{4})-(\d{2})-(\d{2})"
    named = r"(?iu)(\d{1,2})\s+(" + "|".join(MONTHS["fr"]) + r")\s+(\d{4})"
    number = F.regexp_extract(note, iso, 2).try_cast("int")
    from_iso = F.concat_ws(" ", F.regexp_extract(note, iso, 3), F.get(F.array(*map(F.lit, MONTHS["fr"])), number - 1), F.regexp_extract(note, iso, 1))
    from_name = F.concat_ws(" ", F.lpad(F.regexp_extract(note, named, 1), 2, "0"), _canonical(F.regexp_extract(note, named, 2), "fr"), F.regexp_extract(note, named, 3))
    return F.when(note.rlike(iso), F.when(number.between(1, 12), from_iso)).when(note.rlike(named), from_name)


def french_year_month(section: Column) -> tuple[Column, Column]:
    """Year and month of a French section: of a date at its start, else the section is a year, in January; else null (for quarantine)."""
    dated = r"(?iu)^\d{1,2}\s+(" + "|".join(MONTHS["fr"]) + r")\s+(\d{4})"
    bare = F.regexp_replace(section, r"(?U)^\s+|\s+$", "")
    is_dated, is_year = section.rlike(dated), bare.rlike(r"^\d+$")
    year = F.when(is_dated, F.regexp_extract(section, dated, 2)).when(is_year, bare)
    return year, F.when(is_dated, _canonical(F.regexp_extract(section, dated, 1), "fr")).when(is_year, F.lit(MONTHS["fr"][0]))


def portuguese_section(title: Column, year: Column) -> Column:
    """The title, with the year after it unless it ends in four digits; without a title the year."""
    return F.when(title.isNull() | (title == "None"), year).when(title.rlike(r"\d{4}$"), title).otherwise(F.concat(title, F.lit(" de "), year))


def portuguese_month(section: Column) -> Column:
    """The first month of the calendar that the section names as a whole word, else January."""
    found = [F.when(section.rlike(rf"(?iuU)\b{n}\b"), F.lit(n)) for n in MONTHS["pt"]]
    return F.coalesce(*found, F.lit(MONTHS["pt"][0]))
