"""Turning model answers into JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions.keys import strip
from factloom.functions.text import once

THINKING = r"(?s)<think(?:ing)?>.*?</think(?:ing)?>"
_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)
_CLOSER = {"{": "}", "[": "]"}
_BRACKETS = {"{": re.compile(r"[{}]"), "[": re.compile(r"[\[\]]")}
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|\\.|[{}\[\],]', re.S)


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _balanced(text: str, opener: str) -> str | None:
    """Text from the first ``opener`` to the bracket that balances it (strings are not skipped)."""
    start = text.find(opener)
    if start < 0:
        return None
    depth = 0
    for m in _BRACKETS[opener].finditer(text, start):
        depth += 1 if m.group() == opener else -1
        if depth == 0:
            return text[start:m.end()]
    return None


def _close_truncated(text: str):
    """Value of an answer cut off in the middle: drop the last item or just close brackets."""
    opening = re.search(r"[{\[]", text)
    if not opening:
        return None
    body = text[opening.start():]
    pending: list[str] = []
    comma = 0
    for m in _TOKEN.finditer(body):
        token = m.group()
        if token == ",":
            comma = m.start()
        elif token in _CLOSER:
            pending.append(_CLOSER[token])
        elif pending and token == pending[-1]:
            pending.pop()
    if not pending:
        return None
    tail = "".join(reversed(pending))
    for candidate in ([body[:comma] + tail] if comma else []) + [body + tail]:
        value = _load(candidate)
        if value is not None:
            return value
    return None


def _recover(text: str | None) -> str | None:
    """JSON text found in an answer that is not JSON as a whole, else None."""
    if text is None:
        return None
    fence = _FENCE.search(text)
    value = _load(fence.group(1).strip()) if fence else None
    inner = None
    if value is None:
        first = re.search(r"[{\[]", text)
        for opener in "{[":
            piece = _balanced(text, opener)
            found = _load(piece) if piece else None
            if found is None:
                continue
            # a list inside an unreadable object is only a last resort
            if first and first.group() == "{" and opener == "[":
                inner = found
                continue
            value = found
            break
    if value is None:
        value = _close_truncated(text)
    if value is None:
        value = inner
    return None if value is None else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def _recover_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_recover, na_action="ignore")


def with_answer_json(answers: DataFrame, content: str = "content") -> DataFrame:
    """Add ``json``: the JSON text of each answer, NULL if none can be found.

    Thinking is dropped first. Only text Spark cannot parse goes to Python. Each step
    is a column of its own, so no text is parsed twice, and the bare text a generated one, so no filter pushed below repeats it.
    """
    text = F.col(content)
    bare = strip(F.when(text.contains("<think"), F.regexp_replace(text, THINKING, "")).otherwise(text))
    tried = answers.withColumn("_bare", once(bare)).withColumn(
        "_ok", F.col("_bare").rlike(r"^[\[{]") & F.try_parse_json("_bare").isNotNull())
    # text without any bracket holds no JSON but a fenced scalar
    sent = tried.withColumn("_found", _recover_udf(F.when(~F.col("_ok") & F.col("_bare").rlike(r"[\[{]|```"), F.col("_bare"))))
    return sent.withColumn("json", F.when(F.col("_ok"), F.col("_bare")).otherwise(F.col("_found"))).drop("_bare", "_ok", "_found")
