"""The answer in a model's reply: a JSON object with two keys, found in whatever stands around it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys of an answer, and where an object may stand in a reply (fenced, or bare up to the first closing brace).
KEYS = ("answer", "reasoning")
OBJECT = r"```json\s*(\{[\s\S]*?\})\s*```|(\{[\s\S]*?\})"
_object = re.compile(OBJECT)


def candidate(reply: Column | str) -> Column:
    """The fenced object, else the bare one, else the reply as it is."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    pieces = [F.regexp_extract(reply, OBJECT, i) for i in (1, 2)]
    return F.when(pieces[0] != "", pieces[0]).when(pieces[1] != "", pieces[1]).otherwise(reply)


def accepted(text: Column) -> Column:
    """Whether the text is an object that has both keys; their values may be anything, null too."""
    keys = F.json_object_keys(text)
    valid = F.try_parse_json(text).isNotNull()
    return F.coalesce(valid & F.array_contains(keys, KEYS[0]) & F.array_contains(keys, KEYS[1]), F.lit(False))


def field(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def read_reply(reply: str) -> dict | None:
    """The answer in one reply, or None."""
    found = _object.search(reply)
    text = next((g for g in found.groups() if g), reply) if found else reply
    try:
        out = json.loads(text)
    except ValueError:
        return None
    return out if isinstance(out, dict) and all(k in out for k in KEYS) else None


def read_last_resort(reply: str) -> dict | None:
    """The whole reply as JSON; an object without an answer counts as none."""
    try:
        out = json.loads(reply)
    except ValueError:
        return None
    return out if isinstance(out, dict) and KEYS[0] in out else None
