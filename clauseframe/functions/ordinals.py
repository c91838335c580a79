"""Chinese numerals and marker ordinals, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseframe.functions.catalog import DOCUMENT_TYPE, FLAGS, MARKERS
from clauseframe.functions.sql import applied, let, raw

_WIDE = "０１２３４５６７８９"
# Digits and units of Chinese numerals.
_DIGITS, _UNITS = "零一二三四五六七八九", {"十": 10, "百": 100, "千": 1000}


def _cn(text: str) -> str:
    state = lambda t, s, d: f"named_struct('total', {t}, 'part', {s}, 'digit', {d})"
    units = " ".join(f"WHEN '{unit}' THEN {state('n.total', f'n.part + greatest(n.digit, 1L) * {value}L', '0L')}" for unit, value in _UNITS.items())
    other = state("n.total", "n.part", f"cast(greatest(instr('{_DIGITS}', c) - 1, 0) AS bigint)")
    step = f"CASE c WHEN '万' THEN {state('n.total + (n.part + n.digit) * 10000L', '0L', '0L')} {units} WHEN '零' THEN n ELSE {other} END"
    return f"aggregate(filter(split(replace(btrim({text}), '〇', '零'), ''), c -> c <> ''), {state('0L', '0L', '0L')}, (n, c) -> {step}, n -> n.total + n.part + n.digit)"


def cn_to_int(text: Column) -> Column:
    """十 -> 10, 一百零五 -> 105, 十二万三千 -> 123000. A digit after a digit replaces it; other characters count as zero."""
    return applied(f"x -> {_cn('x')}", text)


def int_to_cn(n: Column) -> Column:
    """1 -> 一, 10 -> 十, 105 -> 一百零五; from 1 to 9999."""
    digit = lambda x: F.substring(F.lit(_DIGITS), (x + 1).cast("int"), F.lit(1))
    n = n.cast("long")
    out = F.lit("")
    for value, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = F.floor(n / value) % 10
        bigger, lower = n >= value * 10, n % value
        text = F.when(d > 0, F.concat(digit(d), F.lit(unit))).when(bigger & (lower > 0) & (F.floor(n / (value * 10)) % 10 > 0), F.lit("零")).otherwise("")
        if value == 10:
            text = F.when((d == 1) & (n < 20), F.lit("十")).otherwise(text)
        out = F.concat(out, text)
    return out


def ordinal_sql(kind: str, group: str) -> str:
    """The ordinal as an array of longs; null where it can't be read. kind, group: SQL for the kind of ordinal and its text."""
    dots = let(f"transform(split(replace({group}, '．', '.'), '[.]'), p -> try_cast(translate(p, '{_WIDE}', '0123456789') AS bigint))", "ps", "if(forall(ps, p -> p IS NOT NULL), ps, null)")
    # most are one numeral or a few digits
    one = f"length({group}) = 1 AND instr('{_DIGITS}', {group}) > 0"
    digits = f"regexp_like({group}, '^[0-9]{{1,18}}$')"
    return f"""CASE WHEN {kind} = 'cn' THEN array(if({one}, cast(instr('{_DIGITS}', {group}) - 1 AS bigint), {_cn(group)})) WHEN {kind} = 'one' THEN array(1L)
        WHEN {digits} THEN array(cast({group} AS bigint)) ELSE {dots} END"""


#: The characters with which markers begin, and the patterns of those; numbers in digits begin with any other.
_FIRST = [("第", lambda p: p.startswith("第")), ("（(", lambda p: p.startswith("[（(]")), ("要", lambda p: p.startswith("要")), ("零一二三四五六七八九十百千万", lambda p: re.match(r"(\(\?<!第\))?\(\[零", p))]


def get_ordinal(content: Column) -> Column:
    """The ordinal of the marker that a fragment begins with, or null."""
    begins = lambda pattern: raw(FLAGS + r"\A(?:" + pattern + ")")
    of = {chars: [] for chars, _ in _FIRST} | {"": []}
    for name, kind, pattern in MARKERS:
        if name != DOCUMENT_TYPE:
            of[next((chars for chars, test in _FIRST if test(pattern)), "")].append(f"named_struct('kind', '{kind}', 'text', regexp_extract(x, {begins(pattern)}, 1))")
    # the first form of each is the most frequent one, and is always read
    first = lambda found: let(found[0], "f", f"if(f.text <> '', array(f), array({', '.join(found)}))")
    cases = " ".join(f"WHEN instr('{chars}', left(x, 1)) > 0 THEN {first(found)}" for chars, found in of.items() if chars)
    found = f"CASE {cases} ELSE array({', '.join(of[''])}) END"
    return applied(f"x -> get(array_compact(transform(filter({found}, f -> f.text <> ''), f -> {ordinal_sql('f.kind', 'f.text')})), 0)", content)
