"""Render profiles: how a conversation is written down as one string.

A profile is a row of plain values, so it can be a Python object that becomes
literals, or a row of a small table joined to the chats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Control tokens of the prompt format.
BEGIN = "<BOS_TOKEN>"
TURN_START = "<|START_OF_TURN_TOKEN|>"
TURN_END = "<|END_OF_TURN_TOKEN|>"
SYSTEM_TOKEN = "<|SYSTEM_TOKEN|>"
USER_TOKEN = "<|USER_TOKEN|>"
CHATBOT_TOKEN = "<|CHATBOT_TOKEN|>"
RESPONSE_START = "<|START_RESPONSE|>"
RESPONSE_END = "<|END_RESPONSE|>"

CONTROL_TOKENS = [
    BEGIN,
    TURN_START,
    TURN_END,
    SYSTEM_TOKEN,
    USER_TOKEN,
    CHATBOT_TOKEN,
    RESPONSE_START,
    RESPONSE_END,
]

# Section titles inside the system block.
PREAMBLE_TITLE = "# User Preamble\n"
SAFETY_TITLE = "# Safety Preamble\n"

# Fixed value: the token budget every profile starts from.
MAX_LENGTH = 16384


@dataclass(frozen=True)
class Profile:
    """Framing strings of one prompt format, with their sizes in tokens.

    ``safety_text`` adds a safety section to the system block (and makes the
    block unconditional); ``reply_format_text`` adds a system line before the
    suffix.  Both texts are supplied by the user and off by default.
    """

    name: str
    prefix: str = BEGIN
    system_open: str = TURN_START + SYSTEM_TOKEN
    user_open: str = TURN_START + USER_TOKEN
    chatbot_open: str = TURN_START + CHATBOT_TOKEN
    close: str = TURN_END
    reply_open: str = ""
    reply_close: str = ""
    preamble_title: str = ""
    preamble_always: bool = False
    suffix: str = TURN_START + CHATBOT_TOKEN
    last_prompt_token: str = CHATBOT_TOKEN
    max_length: int = MAX_LENGTH
    prefix_tokens: int = 1
    frame_tokens: int = 3
    reply_frame_tokens: int = 0
    safety_text: str | None = None
    reply_format_text: str | None = None


PLAIN = Profile("plain")
SECTIONED = Profile("sectioned", preamble_title=PREAMBLE_TITLE)
MARKED = Profile(
    "marked",
    reply_open=RESPONSE_START,
    reply_close=RESPONSE_END,
    preamble_always=True,
    suffix=TURN_START + CHATBOT_TOKEN + RESPONSE_START,
    last_prompt_token=RESPONSE_START,
    reply_frame_tokens=2,
)

PROFILES = {p.name: p for p in (PLAIN, SECTIONED, MARKED)}

_TYPES = {"str": "string", "str | None": "string", "int": "int", "bool": "boolean"}
_TYPE_OF = {f.name: _TYPES[f.type] for f in fields(Profile)}
PROFILE_FIELDS = list(_TYPE_OF)
PROFILE_DDL = ", ".join(f"{name} {kind}" for name, kind in _TYPE_OF.items())


class ProfileColumns:
    """The fields of a profile as Columns, made when asked for."""

    def __init__(self, column_of: Callable[[str], Column]):
        self._column_of = column_of

    def __getattr__(self, name: str) -> Column:
        if name not in PROFILE_FIELDS:
            raise AttributeError(name)
        return self._column_of(name)


def profile_columns(profile: Profile | Column) -> ProfileColumns:
    """Columns from the literals of a profile, or from a struct column of its fields."""
    if isinstance(profile, Profile):

        def literal(name: str) -> Column:
            value = getattr(profile, name)
            return F.lit(value) if value is not None else F.lit(None).cast(_TYPE_OF[name])

        return ProfileColumns(literal)
    return ProfileColumns(lambda name: profile[name])


def profiles_frame(spark: SparkSession, profiles: list[Profile] | None = None) -> DataFrame:
    """The profiles as a table, one row per name; made on the driver, so a handful of rows."""
    rows = [
        tuple(getattr(p, name) for name in PROFILE_FIELDS)
        for p in (profiles if profiles is not None else PROFILES.values())
    ]
    return spark.createDataFrame(rows, PROFILE_DDL)


def with_profile(
    chats: DataFrame, name_col: str, profiles: list[Profile] | None = None, out: str = "profile"
) -> DataFrame:
    """Attach the profile struct named by ``name_col``; an unknown name is an error.

    The profile list lives on the driver, which bounds the broadcast side.
    """
    table = profiles_frame(chats.sparkSession, profiles).select(
        F.col("name").alias("_profile_name"), F.struct(*PROFILE_FIELDS).alias(out)
    )
    joined = chats.join(F.broadcast(table), F.col(name_col) == F.col("_profile_name"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown profile: "), F.coalesce(F.col(name_col), F.lit("null"))))
    return joined.withColumn(
        out, F.when(F.col("_profile_name").isNotNull(), F.col(out)).otherwise(unknown)
    ).drop("_profile_name")
