"""Context of a query and the messages sent with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_lookup(rows: DataFrame, ids: str, side: DataFrame, value: str, key: str = "id", by: str = "id", to: str = "found") -> DataFrame:
    """For each row the values of its list of ids, in the list's order; repeated ids repeat, unknown ones are left out."""
    pairs = rows.select(key, F.posexplode(ids).alias("_pos", "_id")).join(side.select(F.col(by).alias("_id"), F.col(value).alias("_value")), "_id")
    lists = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_pos", "_value"))).alias("_x")).select(key, F.transform("_x", lambda x: x["_value"]).alias(to))
    return rows.join(lists, key, "left").withColumn(to, F.coalesce(to, F.expr("cast(array() as array<string>)")))


def missing_ids(rows: DataFrame, ids: str, side: DataFrame, key: str = "id", by: str = "id") -> DataFrame:
    """(key, missing id): what ordered_lookup() leaves out, for a warning."""
    return rows.select(key, F.explode(ids).alias("missing")).join(side.select(F.col(by).alias("missing")), "missing", "left_anti")


def abstracts_of(queries: DataFrame, corpus: DataFrame, mode: str) -> DataFrame:
    """Queries with ``contexts``: the abstracts that the mode (fact, linked, relevant) calls for."""
    lists = {"fact": None, "linked": "linked_articles", "relevant": "relevant_articles"}
    if mode not in lists:
        raise ValueError(f"no mode is called {mode}")
    if lists[mode] is None:
        return queries.withColumn("contexts", F.expr("cast(array() as array<string>)"))
    return ordered_lookup(queries, lists[mode], corpus, "abstract", to="contexts")


def article_text_of(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Queries with ``article_text``: the texts of the relevant articles, joined by spaces."""
    return ordered_lookup(queries, "relevant_articles", corpus, "text", to="_texts").withColumn("article_text", F.array_join("_texts", " ")).drop("_texts")


# The wording of the messages.
_RULES = (
    "Answer with 'yes' if true, 'no' if false, or 'idk' if uncertain.\n"
    "Respond strictly in JSON format with the following keys:\n"
    "  - 'answer': one of 'yes', 'no', 'idk'\n"
    "  - 'reasoning': your reasoning for the answer\n"
    "Provide the reasoning in the same language as the fact and {what}.\n"
    "Do not include any additional text outside the JSON.\n"
    "The 'reasoning' field must be only your explanation in the same language as the input; do not include translations, quoted statements, or any additional markup.\n"
)
_ALONE = (
    "You are solving a factual verification task.\nYou will be given a factual statement.\n"
    "Your task is to verify whether the statement is true, false, or uncertain based on your knowledge.\n"
)
_WITH_ABSTRACTS = (
    "You are solving a factual verification task.\nYou will be given a factual statement and abstracts of Wikipedia articles.\n"
    "Use both your general knowledge and the abstracts to determine factual correctness.\n"
)
SYSTEM = {"fact": _ALONE + _RULES.format(what="articles"), "linked": _WITH_ABSTRACTS + _RULES.format(what="abstracts"), "relevant": _WITH_ABSTRACTS + _RULES.format(what="abstracts")}
UNSURE_CLAUSE, UNSURE_CHOICE, UNSURE_ASK = r",\s*or 'idk' if uncertain\.?", ("one of 'yes', 'no', 'idk'", "one of 'yes', 'no'"), ", or 'idk'"
CORRECTION = "Your last response was not valid JSON with keys 'answer' and 'reasoning'. Please reply strictly with a JSON object containing exactly these two keys."
NO_THINK = "/no_think"


def system_message(mode: str, allow_idk: bool) -> Column:
    text = F.lit(SYSTEM[mode])
    return text if allow_idk else F.replace(F.regexp_replace(text, UNSURE_CLAUSE, ""), F.lit(UNSURE_CHOICE[0]), F.lit(UNSURE_CHOICE[1]))


def user_message(fact: Column | str, contexts: Column | str | None, mode: str, allow_idk: bool, no_think: bool = False) -> Column:
    fact = F.col(fact) if isinstance(fact, str) else fact
    if mode == "fact":
        text = F.concat(F.lit('Is the following statement factually correct: "'), fact, F.lit('"?'))
    else:
        head = {"linked": "ABSTRACTS", "relevant": "RELEVANT ABSTRACTS"}[mode]
        ask = "Is the following statement factually correct based on your knowledge and the abstracts below?"
        text = F.concat(F.lit(f'{ask}\n\nFACT:\n"'), fact, F.lit(f'"\n\n{head}:\n\n'), F.array_join(contexts, "\n\n"))
    text = text if allow_idk else F.replace(text, F.lit(UNSURE_ASK), F.lit(""))
    return F.concat(text, F.lit(NO_THINK)) if no_think else text


def messages(fact: Column | str, contexts: Column | str | None, mode: str, allow_idk: bool = False, no_think: bool = False) -> Column:
    """array<struct<role, content>>"""
    return F.array(
        F.struct(F.lit("system").alias("role"), system_message(mode, allow_idk).alias("content")),
        F.struct(F.lit("user").alias("role"), user_message(fact, contexts, mode, allow_idk, no_think).alias("content")),
    )
