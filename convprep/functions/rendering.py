"""Rendering of messages to prompt text, and the matching token costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convprep.functions.messages import CHATBOT, SYSTEM, USER
from convprep.profiles import BEGIN, SAFETY_TITLE, ProfileColumns


def _is_reply(m: Column) -> Column:
    return m["role"] == CHATBOT


def message_text(p: ProfileColumns, m: Column) -> Column:
    """One framed message; empty text renders to nothing, an unknown role is an error."""
    role = m["role"]
    opening = (
        F.when(role == USER, p.user_open)
        .when(_is_reply(m), F.concat(p.chatbot_open, p.reply_open))
        .when(role == SYSTEM, p.system_open)
        .otherwise(F.raise_error(F.concat(F.lit("unknown role: "), role)).cast("string"))
    )
    closing = F.when(_is_reply(m), F.concat(p.reply_close, p.close)).otherwise(p.close)
    return F.when(m["content"] == "", "").otherwise(F.concat(opening, m["content"], closing))


def counted_text(p: ProfileColumns, counter, m: Column) -> Column:
    """The text of a message to hand to the counter: its content, or all of it with its frame."""
    return message_text(p, m) if counter.framed else m["content"]


def message_cost(p: ProfileColumns, counter, m: Column, counted: Column) -> Column:
    """Tokens of a framed message, given the count of its ``counted_text``."""
    frame = p.frame_tokens + F.when(_is_reply(m), p.reply_frame_tokens).otherwise(0)
    return F.when(m["content"] == "", 0).otherwise(counted if counter.framed else frame + counted)


def preamble_shown(p: ProfileColumns, preamble: Column) -> Column:
    return (preamble != "") | p.preamble_always | p.safety_text.isNotNull()


def preamble_body(p: ProfileColumns, preamble: Column) -> Column:
    """Text inside the system block: optional safety section, title, preamble."""
    safety = F.coalesce(F.concat(F.lit(SAFETY_TITLE), p.safety_text, F.lit("\n\n")), F.lit(""))
    return F.concat(safety, p.preamble_title, preamble)


def preamble_text(p: ProfileColumns, preamble: Column) -> Column:
    block = F.concat(p.system_open, preamble_body(p, preamble), p.close)
    return F.when(preamble_shown(p, preamble), block).otherwise("")


def _format_line(p: ProfileColumns) -> Column:
    return F.coalesce(F.concat(p.system_open, p.reply_format_text, p.close), F.lit(""))


def tail_text(p: ProfileColumns) -> Column:
    """What follows the last message: an optional system line, then the generation cue."""
    return F.concat(_format_line(p), p.suffix)


def base_cost(p: ProfileColumns, counter, preamble: Column) -> Column:
    """Tokens of everything but the turns and the generation cue."""
    if counter.framed:
        return counter.count(F.concat(open_prompt(p, preamble), _format_line(p)))
    shown = p.frame_tokens + counter.count(preamble_body(p, preamble))
    line = F.coalesce(p.frame_tokens + counter.count(p.reply_format_text), F.lit(0))
    return p.prefix_tokens + F.when(preamble_shown(p, preamble), shown).otherwise(0) + line


def strip_begin(prompt: Column, begin: str = BEGIN) -> Column:
    """Remove the first begin token, wherever it stands."""
    at = F.instr(prompt, F.lit(begin))
    rest = F.concat(F.substring(prompt, F.lit(1), at - 1), F.substring(prompt, at + len(begin), F.length(prompt)))
    return F.when(at > 0, rest).otherwise(prompt)


def open_prompt(p: ProfileColumns, preamble: Column) -> Column:
    """Prefix and preamble block, as they stand before the first message."""
    return F.concat(p.prefix, preamble_text(p, preamble))


def template_text(p: ProfileColumns, preamble: Column, messages: Column) -> Column:
    """The whole conversation, begin token included; it ends with the last message."""
    pieces = F.transform(messages, lambda m: message_text(p, m))
    return F.concat(open_prompt(p, preamble), F.array_join(pieces, ""))


def render_messages(p: ProfileColumns, preamble: Column, messages: Column) -> Column:
    """The whole conversation followed by the generation cue, begin token included."""
    return F.concat(template_text(p, preamble, messages), tail_text(p))


def training_text(prompt: Column, completion: Column) -> Column:
    """Prompt and completion joined, without the spaces at the seam."""
    return F.concat(F.rtrim(prompt), F.ltrim(completion))


def reply_between(decoded: Column, prompt: Column, end_token: str) -> Column:
    """What stands between the prompt and the end token; NULL if either is missing."""
    whole = F.startswith(decoded, prompt) & F.endswith(decoded, F.lit(end_token))
    size = F.length(decoded) - F.length(prompt) - len(end_token)
    return F.when(whole & (size >= 0), F.substring(decoded, F.length(prompt) + 1, size))
