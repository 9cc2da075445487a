"""The text function of the translation bridge, as a Pandas UDF, and checks of its replies."""

from __future__ import annotations

import json
import re
import time
import unicodedata
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import STYLE_MARKER, refused, same_placeholders


def translation(factory: Callable[[], Callable[[str], str]]):
    """A column function from a factory of text functions; a worker makes one and uses it for all its batches."""
    held = []

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(factory())
        return texts.map(held[0], na_action="ignore")

    return run


def reversed_words() -> Callable[[str], str]:
    """A deterministic stand-in for a translator: words in reverse order, tags kept."""
    return lambda text: " ".join(reversed(text.split(" ")))


#: The replies after which a request is sent again, how often, and the largest reply.
RETRIED, ATTEMPTS, LARGEST_REPLY = (408, 429, 500, 502, 503, 504), 3, 4 << 20


class TranslationError(RuntimeError):
    pass


def pause(attempt: int) -> float:
    """Seconds before the next attempt: doubled each time, eight at most."""
    return min(8.0, 2.0**attempt)


def chat_translator(base: str, model: str, key: str = "", source: str = "en", target: str = "zh-CN", timeout: float = 120.0, send: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> Callable[[], Callable[[str], str]]:
    """A factory for ``translation``: texts go one by one to a chat-completion service.

    Requests that fail for a time are sent again after a pause. A reply must be text, of
    bounded size, with each style tag as often as in the request.
    """
    url = urlsplit(base)
    if url.scheme not in ("http", "https") or not url.hostname or url.username or url.password or url.query or url.fragment:
        raise ValueError("not a plain service address")
    if not isinstance(model, str) or not model:
        raise ValueError("a model is needed")
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    order = f"Translate from {source} to {target}. Give the translation alone, with all <bN>, </bN> and formula placeholders, citations, numbers and paragraph breaks as they are."

    def read(request: urllib.request.Request) -> str:
        with send(request, timeout=timeout) as reply:
            raw = reply.read(LARGEST_REPLY + 1)
        if len(raw) > LARGEST_REPLY:
            raise TranslationError("the reply is too large")
        try:
            text = json.loads(raw)["choices"][0]["message"]["content"]
        except (ValueError, LookupError, TypeError):
            raise TranslationError("the reply is not a completion") from None
        if not isinstance(text, str) or not text.strip():
            raise TranslationError("the reply has no text")
        return text

    def translate(text: str) -> str:
        body = json.dumps({"model": model, "messages": [{"role": "system", "content": order}, {"role": "user", "content": text}]}).encode()
        for attempt in range(ATTEMPTS):
            try:
                found = read(urllib.request.Request(f"{base.rstrip('/')}/chat/completions", data=body, headers=headers))
                break
            except urllib.error.HTTPError as error:
                problem, again = f"HTTP {error.code}", error.code in RETRIED
            except (urllib.error.URLError, TimeoutError):
                problem, again = "no connection", True
            if not again or attempt == ATTEMPTS - 1:
                raise TranslationError(problem)
            sleep(pause(attempt))
        if any(found.count(tag) != text.count(tag) for tag in set(re.findall(STYLE_MARKER, text))):
            raise TranslationError("the reply lacks a placeholder")
        return found

    return lambda: translate


def checked(requests: DataFrame, reply: Column) -> DataFrame:
    """``reply`` and ``problem``: placeholder where tags differ, refused where a text came back as it was; else null."""
    found = requests.withColumn("reply", reply)
    bad = F.when(~same_placeholders(F.col("text"), F.col("reply")), "placeholder").when(refused(F.col("text"), F.col("reply")), "refused")
    return found.withColumn("problem", bad)


def nfkc(column: Column | str) -> Column:
    """Compatibility normalisation, for which there is no built-in function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(column)
