"""The verdict on each fact: a pluggable call with retries, and its coverage of the keywords."""

from __future__ import annotations

import functools
import inspect
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import read_last_resort, read_reply
from ..functions.lemmas import for_coverage, lemmatize_with
from ..functions.vectors import ratio
from ..sources.storage import stored
from .calls import CHUNK, WIDTH, called, called_by_chunks, in_chunks, results, timed
from .context import CORRECTION

#: Messages -> the reply's text. Made on the driver, sent to the tasks, called from several threads of one; may raise. It gets those of the
#: sampling parameters that it takes by name.
Chat = Callable[[list[dict]], str]
#: Attempts for a fact, seconds between them, and how a chat model is asked.
ATTEMPTS, PAUSE, SAMPLING = 3, 1.0, {"temperature": 0.1, "top_p": 0.9, "timeout": 360}
VERDICT = "id string, text string, keywords array<string>, prompt string, answer string, reasoning string, raw string, attempts int, failed boolean"


def sampled(chat: Chat, sampling: dict) -> Chat:
    """``chat`` with those of the sampling parameters that it takes by name."""
    takes = inspect.signature(chat).parameters
    anything = any(p.kind is p.VAR_KEYWORD for p in takes.values())
    given = {k: v for k, v in sampling.items() if anything or k in takes}
    return functools.partial(chat, **given) if given else chat


def ask(chat: Chat, messages: list[dict], attempts: int = ATTEMPTS, pause: float = PAUSE, timeout: float | None = None) -> tuple:
    """(answer, reasoning, raw, attempts, failed). A reply without both keys is answered with a correction; an error, or no reply in time, is
    tried again as it is."""
    said, last, call = list(messages), "", timed(chat, timeout)
    for n in range(1, attempts + 1):
        try:
            last = call(said).strip()
            found = read_reply(last)
        except Exception:  # any failure of the call counts as an attempt
            found = None
        else:
            if found is None:
                said = [*said, {"role": "system", "content": CORRECTION}]
        if found is not None:
            break
        if n < attempts:
            time.sleep(pause)
    else:
        n, found = attempts, read_last_resort(last)
    if found is None:
        return None, None, last, n, True
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return text(found["answer"]), text(found.get("reasoning", "")), json.dumps(found, ensure_ascii=False), n, False


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("id", "text", "keywords", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _verdict(chat: Chat, attempts: int, pause: float, sampling: dict) -> Callable[[dict], tuple]:
    chat = sampled(chat, sampling)

    def call(r: dict) -> tuple:
        messages = [dict(role=m["role"], content=m["content"]) for m in r["messages"]]
        return (r["id"], r["text"], None if r["keywords"] is None else list(r["keywords"]), messages[-1]["content"], *ask(chat, messages, attempts, pause, sampling.get("timeout")))

    return call


def verdicts(queries: DataFrame, chat: Chat, attempts: int = ATTEMPTS, pause: float = PAUSE, sampling: dict = SAMPLING, width: int = WIDTH, rate: float | None = None) -> DataFrame:
    """queries (id, text, keywords, messages) -> id, text, keywords, prompt, answer, reasoning, raw, attempts, failed, in the order of the replies.

    Each task has ``width`` calls in flight. A task that is run again calls again: store the result before anything else reads it, or use
    kept_verdicts().
    """
    return called(_asked(queries), _verdict(chat, attempts, pause, sampling), VERDICT, width, rate)


def kept_verdicts(queries: DataFrame, chat: Chat, folder: str, attempts: int = ATTEMPTS, pause: float = PAUSE, sampling: dict = SAMPLING, width: int = WIDTH, rate: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """The same, kept in ``folder`` chunk by chunk as they are done; returns what is there in the end."""
    rows = stored(in_chunks(_asked(queries), chunk), "asked")
    ledger = called_by_chunks(rows, _verdict(chat, attempts, pause, sampling), VERDICT, folder, width, rate)
    ledger.write.format("noop").mode("overwrite").save()
    return results(queries.sparkSession, folder, VERDICT)


def coverage(keywords: Column | str, reasoning: Column | str, lang: str = "en") -> Column:
    """Share of the keywords' lemmas that are among the reasoning's; null without keywords, 0 if none has letters only."""
    lemmatize = lemmatize_with(lang)
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    wanted = F.array_distinct(for_coverage(lemmatize(F.flatten(F.transform(keywords, tokens)))))
    said = for_coverage(lemmatize(tokens(F.coalesce(reasoning, F.lit("")))))
    return F.when(F.size(keywords) > 0, ratio(F.size(F.array_intersect(wanted, said)), F.size(wanted)))
