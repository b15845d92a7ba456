"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest term in bytes; window and stride of chunks in tokens; lengths of snippets and previews.
TERM_BYTES, CHUNK, STRIDE, SNIPPET, PREVIEW = 128, 510, 446, 160, 96
_TOKEN = r"[\p{IsAlphabetic}\p{N}]+"


def raw_tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, in their own case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased after the split."""
    return F.transform(raw_tokens(text), F.lower)


def doc_len(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_TOKEN))


def clip_term(term: Column) -> Column:
    """The term's longest prefix of whole characters within TERM_BYTES. A character that is cut leaves the sign for broken bytes, which no term holds."""
    cut = F.make_valid_utf8(F.substring(term.cast("binary"), 1, TERM_BYTES).cast("string"))
    return F.when(F.octet_length(term) <= TERM_BYTES, term).otherwise(F.rtrim(cut, F.lit("\ufffd")))


def chunk_count(n_tokens: Column) -> Column:
    return F.when(n_tokens <= CHUNK, F.lit(1)).otherwise(1 + F.ceil((n_tokens - CHUNK) / F.lit(STRIDE))).cast("int")


def chunk_windows(toks: Column) -> Column:
    """Windows of CHUNK tokens every STRIDE tokens; the last ends with the text."""
    return F.transform(F.sequence(F.lit(0), chunk_count(F.size(toks)) - 1), lambda i: F.slice(toks, i * STRIDE + 1, CHUNK))


def cut_text(text: Column, limit: int) -> Column:
    """The first `limit` characters, with an ellipsis if any are left out."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def snippet(text: Column) -> Column:
    return cut_text(text, SNIPPET)


def preview(text: Column) -> Column:
    """The first line, cut to PREVIEW characters; an ellipsis if anything is left out."""
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    more = (F.length(line) > PREVIEW) | F.contains(text, F.lit("\n"))
    return F.when(more, F.concat(F.substring(line, 1, PREVIEW), F.lit("…"))).otherwise(line)


def is_ulid(text: Column) -> Column:
    return text.rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")
