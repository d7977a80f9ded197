"""Token counting.

A counter works on arrays of texts at the top level of a plan, never inside a
lambda, so the same operators accept a JVM-side counter and an Arrow-batched
one around a user's tokenizer.

Costs add up: control tokens part the text before any merging of sub-words, so
the size of a prompt is the sum over its messages.  A counter with ``framed``
set is given each message with its control tokens and need not agree with the
frame sizes of the profile.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.profiles import BEGIN, CHATBOT_TOKEN, CONTROL_TOKENS, RESPONSE_START, TURN_END, TURN_START

WORD = r"[^ \t\n\r\f]+"

# Candidate sequence lengths.
CANDIDATE_LENGTHS = [512, 1024, 2048, 4096, 8192, 16384]

# All control tokens begin with the same character, which lets the matcher skip fast.
_CONTROL_PATTERN = "(<(?:" + "|".join(re.escape(t.removeprefix("<")) for t in CONTROL_TOKENS) + "))"


def spaced_controls(text: Column) -> Column:
    """Put spaces around control tokens so that each counts as one word."""
    return F.regexp_replace(text, _CONTROL_PATTERN, " $1 ")


def split_words(text: Column) -> Column:
    """Words and control tokens of a rendered string, in order."""
    return F.regexp_extract_all(spaced_controls(text), F.lit(WORD), F.lit(0))


class WordCounter:
    """Whitespace words, counted by a built-in expression."""

    framed = False

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(WORD))

    def count_all(self, texts: Column) -> Column:
        return F.transform(texts, self.count)

    def count_rendered(self, text: Column) -> Column:
        """Tokens of a string that holds control tokens, each counting as one."""
        return F.regexp_count(spaced_controls(text), F.lit(WORD))


_LOADED: dict[str, object] = {}


def _tokenizer(file_name: str):
    if file_name not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[file_name] = Tokenizer.from_file(SparkFiles.get(file_name))
    return _LOADED[file_name]


class TokenizerCounter:
    """Counts with a user's ``tokenizer.json``, shipped once to every executor."""

    framed = True

    def __init__(self, spark: SparkSession, path: str):
        spark.sparkContext.addFile(path)
        self._file = path.rsplit("/", 1)[-1]

    def ids(self, text: Column) -> Column:
        name = self._file

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode(texts: pd.Series) -> pd.Series:
            encoded = _tokenizer(name).encode_batch(list(texts), add_special_tokens=False)
            return pd.Series([e.ids for e in encoded])

        return encode(text)

    def count(self, text: Column) -> Column:
        return F.size(self.ids(text))

    count_rendered = count

    def count_all(self, texts: Column) -> Column:
        name = self._file

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def count(batches: pd.Series) -> pd.Series:
            sizes = [len(b) for b in batches]
            flat = [t for b in batches for t in b]
            encoded = _tokenizer(name).encode_batch(flat, add_special_tokens=False)
            counts = iter([len(e.ids) for e in encoded])
            return pd.Series([[next(counts) for _ in range(n)] for n in sizes])

        return count(texts)


def rendered_tokens(text: Column, counter: WordCounter | TokenizerCounter | None = None) -> Column:
    """Size of a rendered string, leaving out the trailing generation cue.

    A string that carries its own begin token and ends in a closed turn or a
    cue is counted as it stands, minus the cue; any other string is counted
    as if the missing begin and end tokens were added.
    """
    counter = counter or WordCounter()
    begun = F.startswith(text, F.lit(BEGIN))
    cue = TURN_END + TURN_START + CHATBOT_TOKEN
    adjust = (
        F.when(begun & F.endswith(text, F.lit(cue + RESPONSE_START)), -3)
        .when(begun & F.endswith(text, F.lit(cue)), -2)
        .otherwise(F.when(begun, 0).otherwise(1) + F.when(F.endswith(text, F.lit(TURN_END)), 0).otherwise(1))
    )
    return counter.count_rendered(text) + adjust


def length_bucket(n_tokens: Column, candidates: list[int] | None = None) -> Column:
    """Smallest candidate strictly above ``n_tokens``; NULL when there is none."""
    sizes = F.sort_array(F.array(*[F.lit(c) for c in (candidates or CANDIDATE_LENGTHS)]))
    return F.get(F.filter(sizes, lambda c: c > n_tokens), F.lit(0))
