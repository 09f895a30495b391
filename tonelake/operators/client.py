"""A language model as a function over columns: several providers, tried in turn."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tries of a provider, seconds before the second try and at most; what an error says that is worth another try, or another provider.
TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 30.0
RATE_LIMITED = re.compile(r"(?i)rate.?limit|429|quota|too many requests")
RETRYABLE = re.compile(r"(?i)timeout|timed out|503|502|500|connection|overloaded|temporar")

Provider = Callable[[str, str], str]


def is_rate_limited(error: str) -> bool:
    return RATE_LIMITED.search(error) is not None


def is_retryable(error: str) -> bool:
    return RETRYABLE.search(error) is not None


def complete(providers: list[Provider], system: str, prompt: str, wait: Callable[[float], None] = time.sleep) -> str | None:
    """The first reply that a provider gives. A rate limit passes on to the next provider at once, an error worth another try is tried again after a doubling wait,
    any other error passes on; null if all fail."""
    for provider in providers:
        for tries in range(1, TRIES + 1):
            try:
                return provider(system, prompt)
            except Exception as e:  # whatever a provider raises is its failure, not ours
                if is_rate_limited(str(e)) or not is_retryable(str(e)) or tries == TRIES:
                    break
                wait(min(FIRST_WAIT * 2 ** (tries - 1), LONGEST_WAIT))
    return None


def completer(load: Callable[[], list[Provider]], system: str = ""):
    """A column function: prompt to reply. The providers are made once in each worker; a null prompt has a null reply, and so has one that all providers failed at."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            providers = load()
        except Exception:
            providers = []
        for prompts in batches:
            yield prompts.map(lambda p: None if p is None else complete(providers, system, p))

    return run
