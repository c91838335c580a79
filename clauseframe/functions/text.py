"""Cleaning and paragraph counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseframe.functions.catalog import FLAGS
from clauseframe.functions.sql import applied, let, raw


def clean_html(text: Column) -> Column:
    """Tags out, entities decoded, dash ordinals made numerals, blanks and line ends collapsed, ends trimmed. Null stays null.

    A text that holds nothing to be replaced is left as it is, which a look for single characters tells.
    """
    out = f"regexp_replace(x, {raw(FLAGS + '<[A-Za-z/!][^>]*>')}, '')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    for pattern, by in ((r"(^|[\s>])[-—]、", "$1一、"), ("（[-—]）", "（一）"), (r"\([-—]\)", "(一)")):
        out = f"regexp_replace({out}, {raw(FLAGS + pattern)}, '{by}')"
    holds = lambda *parts: " OR ".join(f"contains(x, '{p}')" for p in parts)
    out = f"if({holds('<', '&', '-', '—')}, {out}, x)"
    blanks = raw(FLAGS + r"[ \t\x{00a0}\x{3000}\r\f\x0b]+")
    one = f"if({holds('  ', *map(r'\u{:04x}'.format, (9, 0xA0, 0x3000, 13, 12, 11)))}, regexp_replace(x, {blanks}, ' '), x)"
    lines = f"if({holds(' ' + chr(92) + 'n', chr(92) + 'n ', chr(92) + 'n' + chr(92) + 'n')}, regexp_replace(x, {raw(FLAGS + ' *' + chr(92) + 'n[ ' + chr(92) + 'n]*')}, '{chr(92)}n'), x)"
    return F.btrim(applied("x -> " + let(out, "x", let(one, "x", lines)), text), F.lit(" \n"))


def paragraphs(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(FLAGS + r"\S"))


def count_paragraphs(text: Column) -> Column:
    return F.size(paragraphs(text))
