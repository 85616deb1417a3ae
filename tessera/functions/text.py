"""Text expressions: strip, markup cleaning, sentence tiles with offsets, tokens and numbers.

All are Catalyst expressions. Offsets are code points from 0, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.strip removes, as a character class body for Java and RE2.
WS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F"

#: The same characters one by one.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

#: The markup cleaner's steps in their order; pattern, Java flags, replacement (group by number).
CLEANER = (
    (r"<!--.*?-->", "s", ""),
    (r"\{\{.*?\}\}", "s", ""),
    (r"<ref[^>]*>.*?</ref>", "is", ""),
    (r"<ref[^>]*/>", "i", ""),
    (r"<[^>]+>", "", ""),
    (r"\[\[File:.*?\]\]", "id", ""),
    (r"\[\[Image:.*?\]\]", "id", ""),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "", "2"),
    (r"\[\[([^\]]+)\]\]", "", "1"),
    (rf"\[https?://[^{WS}\]]+[{WS}]+([^\]]+)\]", "", "1"),
    (rf"\[https?://[^{WS}\]]+\]", "", ""),
    (r"'''", "", ""),
    (r"''", "", ""),
    (r"\n{3,}", "", "\n\n"),
)

#: Sentences as the rule splitter sees them, and what lies between: the four alternatives tile any text.
RULE_TILE = rf"[^.!?]++[.!?]++(?:[{WS}]++|\z)|[^.!?]++[.!?]++|[^.!?]++|[.!?]++"
RULE_SENTENCE = rf"^[^.!?]+[.!?]+[{WS}]+$"
RULE_LAST = r"^[^.!?]+[.!?]+$"
#: Sentences without loss: a run of terminators ends one only before white space or the end.
LOSSLESS_TILE = rf"(?:[^.!?]++|[.!?]+[^{WS}.!?])*+[.!?]+(?:[{WS}]+|\z)|(?:[^.!?]++|[.!?]+[^{WS}.!?])++"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), rf"\A[{WS}]+|[{WS}]+\z", "")


def piece_strip(c: Column) -> Column:
    """strip of a short piece: spaces go first, and only if white space is left at an edge is the pattern asked."""
    own = F.trim(c)
    edge = lambda at: (F.length(own) > 0) & (F.instr(F.lit(WS_CHARS), F.substring(own, at, 1)) > 0)
    return F.when(edge(1) | edge(-1), strip(own)).otherwise(own)


def trimmed(c: str | Column) -> Column:
    """strip of a whole text without a scan of its inside; for pieces in a lambda strip is the faster one."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def blank(c: str | Column) -> Column:
    return F.length(strip(F.coalesce(_col(c), F.lit("")))) == 0


#: Every step's match holds one of these, so a text without any is left as it is.
MARKS = ("<", "{{", "[", "''", "\n\n\n")


def clean_markup(c: str | Column) -> Column:
    """Markup out, contents kept; the steps' order is part of the meaning."""
    text = out = _col(c)
    for pattern, flags, group in CLEANER:
        out = F.regexp_replace(out, (f"(?{flags})" if flags else "") + pattern, f"${group}" if group.isdigit() else group)
    marked = F.contains(text, F.lit(MARKS[0]))
    for m in MARKS[1:]:
        marked |= F.contains(text, F.lit(m))
    return trimmed(F.when(marked, out).otherwise(text))


def tiles(c: str | Column, pattern: str) -> Column:
    """The pieces of a text, none lost: array of strings."""
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda a plain expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column, block: int = 256) -> Column:
    """Running sums of an array of integers, in blocks: an array that is added to is copied whole, so none gets long."""
    def sums(first: Column, rest: Column) -> Column:
        return F.aggregate(rest, first, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def joined(inner: Column) -> Column:
        totals = F.transform(inner, lambda b: F.when(F.size(b) > 0, F.element_at(b, -1)).otherwise(0))
        bases = F.slice(sums(F.array(F.lit(0)), totals), 1, F.size(inner))
        return F.flatten(F.zip_with(inner, bases, lambda b, base: F.transform(b, lambda x: x + base)))

    def blocks(n: Column) -> Column:
        parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")))
        own = F.transform(parts, lambda b: F.slice(n, b * block + 1, block))
        return bound(F.transform(own, lambda b: sums(F.slice(b, 1, 1), F.slice(b, 2, block))), joined)

    return bound(sizes, blocks)


def ends(pieces: Column) -> Column:
    """Where each piece ends."""
    return running(F.transform(pieces, lambda x: F.length(x)))


def spans(pieces: Column, until: Column) -> Column:
    """Array of text, start, end from pieces and their ends."""
    return F.zip_with(pieces, until, lambda p, e: F.struct(p.alias("text"), (e - F.length(p)).alias("start"), e.alias("end")))


def tokens(c: str | Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def numbers(c: str | Column) -> Column:
    """Numbers as written: digits with inner points or commas."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
