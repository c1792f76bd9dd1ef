"""Flattening documents and reading model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widest indentation removed after a line feed, refusal mark,
# code fence and language tag of a reply.
MAX_INDENT = 20
REFUSAL = "NO"
FENCE = "```"
SQL_TAG = "sql"

# Everything Python's str.strip() treats as white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def drop_line_feeds(text: Column) -> Column:
    """Remove each line feed with up to 20 spaces after it, widest run first.

    Where no line feed is followed by more spaces than that, every run goes
    whole and one pattern does the same in a single pass. A wider run leaves
    spaces behind, which a line feed stacked before it may then take along, so
    texts with one go through the widths one after the other.
    """
    wider = F.contains(text, F.lit("\n" + " " * (MAX_INDENT + 1)))
    stepwise = text
    for width in range(MAX_INDENT, -1, -1):
        stepwise = F.replace(stepwise, F.lit("\n" + " " * width), F.lit(""))
    at_once = F.regexp_replace(text, rf"\n {{0,{MAX_INDENT}}}", "")
    return F.when(wider, stepwise).when(F.contains(text, F.lit("\n")), at_once).otherwise(text)


def escape_braces(text: Column) -> Column:
    doubled = F.replace(text, F.lit("{"), F.lit("{{"))
    return F.replace(doubled, F.lit("}"), F.lit("}}"))


def flatten_text(text: Column) -> Column:
    return escape_braces(drop_line_feeds(text))


# What is said of a reply that never came.
NO_REPLY = "no reply"


def reply_status(text: Column, strict: bool = False) -> Column:
    """A missing reply is an error."""
    failed = text.isNull() | _refused(text, strict)
    return F.when(failed, F.lit("error")).otherwise(F.lit("success"))


def reply_message(text: Column, strict: bool = False) -> Column:
    """The reason of a refusal, or the SQL text of an answer.

    By default the refusal mark counts anywhere in the reply, so ``NOT NULL``
    reads as a refusal, and line feeds become spaces, which lets a ``--``
    comment swallow what follows. ``strict`` looks for the mark at the start
    only and keeps the line feeds.
    """
    has_fence = F.contains(text, F.lit(FENCE))
    body = F.when(has_fence, F.split_part(text, F.lit(FENCE), F.lit(2))).otherwise(text)
    if not strict:
        body = F.replace(body, F.lit("\n"), F.lit(" "))
    body = strip(body)
    tagged = F.startswith(body, F.lit(SQL_TAG))
    sql = F.when(tagged, F.substring(body, len(SQL_TAG) + 1, 2**31 - 1)).otherwise(body)
    if strict:
        reason = strip(F.substring(strip(text), len(REFUSAL) + 1, 2**31 - 1))
        sql = strip(sql)
    else:
        reason = F.split_part(text, F.lit(REFUSAL), F.lit(2))
    message = F.when(_refused(text, strict), reason).otherwise(sql)
    return F.when(text.isNull(), F.lit(NO_REPLY)).otherwise(message)


def _refused(text: Column, strict: bool) -> Column:
    if strict:
        return F.regexp_like(strip(text), F.lit(rf"^{REFUSAL}\b"))
    return F.contains(text, F.lit(REFUSAL))
