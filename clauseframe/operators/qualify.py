"""Which marker types structure a document: the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseframe.functions import catalog as C
from clauseframe.functions.sql import applied, let, texts
from clauseframe.functions.text import count_paragraphs
from clauseframe.operators.mask import count_effective_paragraphs

SHORT, LONG_PARAGRAPH = 1000, 70


def _tags() -> str:
    """All tags of a document, from the qualified types s.tags and the statistics x.b."""
    at = {t: f"x.b[{i}]" for i, t in enumerate(C.TYPES)}
    has = lambda tags, t: f"array_contains({tags}, '{t}')"
    # articles in chapters bring sections and parts with them
    more = ", ".join(f"if({at[t]}.count > 0, '{t}', null)" for t in ("节", "编"))
    whole = f"if({has('s.tags', '条')} AND {has('s.tags', '章')}, array_union(s.tags, array_compact(array({more}))), s.tags)"
    # brackets that restart far more often than what holds them are fragments, unless dotted numbers were suppressed
    dotted = " OR ".join(f"coalesce(x.c[{C.TYPES.index(t)}] = '条内抑制', false)" for t in ("数字点", "数字点点"))
    broken = lambda t: " OR ".join(f"({has('u', ref)} AND {at[ref]}.group_count > 0 AND {at[t]}.group_count >= 3 * {at[ref]}.group_count AND {at[t]}.max_n <= 4)" for ref in ("中文顿号", "条", "数字条"))
    gone = ", ".join(f"if(({broken(t)}) AND NOT ({dotted}), '{t}', null)" for t in ("括号", "括号数字"))
    forced = ", ".join(f"if({at[t]}.count >= 3 AND {at[t]}.max_n >= 3, '{t}', null)" for t in ("中文是", "部分", "要素数字冒号"))
    direct = f"if(size(array_except(v, {texts(['数字点', '数字点点'])})) = 0 AND {at['数字直连中文']}.count > 0, array('数字直连中文'), cast(array() AS array<string>))"
    return let(whole, "u", let(f"array_union(array_except(u, array_compact(array({gone}))), array_compact(array({forced})))", "v", f"sort_array(array_union(v, {direct}))"))


def _qualified() -> str:
    """The types that structure a text, of the statistics x.b and suppressions x.c, with their longest run and groups."""
    general = "x.c[i] IS NULL AND e.count >= 3 AND (e.group_count >= 2 OR e.group_count >= 1 AND e.max_n >= 3)"
    item = f"if(e.type = '{C.DOCUMENT_TYPE}', named_struct('type', e.type, 'n', 0, 'gc', e.count), named_struct('type', e.type, 'n', e.max_n, 'gc', e.group_count))"
    # enumerations qualify by less, after all others
    late = "e.type = '中文顿号' AND x.c[i] IS NULL AND e.group_count >= 1 AND e.max_n >= 2"
    rows = lambda test: f"array_compact(transform(x.b, (e, i) -> if({test}, {item}, null)))"
    return f"concat({rows(general)}, {rows(f'{late} AND NOT ({general})')})"


def qualified(found: Column, reasons: Column) -> Column:
    """array<struct<type, n, gc>> of the types that qualify, in order; the report's tags come from them."""
    return applied(f"x -> {_qualified()}", F.lit(None).cast("int"), found, reasons)


def near_misses(q: Column) -> tuple[Column, Column]:
    """Of qualified types: those whose longest run is one short of the longest, and those with one group less than the most; neither in the spine, nor satellites the latter."""
    shown = lambda test: applied(f"q -> {let('named_struct(' + repr('n') + ', array_max(q.n), ' + repr('gc') + ', array_max(q.gc))', 'm', f'transform(filter(q, y -> {test}), y -> y.type)')}", q)
    return shown("y.n >= m.n - 1 AND y.n <> m.n"), shown("y.gc >= m.gc - 1 AND y.n <> m.n AND y.gc <> m.gc")


def report(text: Column, found: Column, reasons: Column) -> Column:
    """text: the cleaned text; found, reasons: the statistics and suppressions by type, both in the catalogue's order."""
    qualified = _qualified()
    plain = f"if(x.a < {SHORT}, '{C.PLAIN}', if(x.a / x.d > {LONG_PARAGRAPH}, '{C.PLAIN_PARAGRAPHS}', '{C.PLAIN}'))"
    of_plain = lambda kind: f"named_struct('spine_types', array({kind}), 'satellite_types', cast(array() AS array<string>), 'all_tags', array({kind}), 'max_n', 0, 'max_gc', 0, 'is_plain', true, 'char_count', x.a, 'para_count', x.e)"
    structured = let(
        "named_struct('n', array_max(q.n), 'gc', array_max(q.gc), 'tags', q.type)",
        "s",
        f"named_struct('spine_types', transform(filter(q, y -> y.n = s.n), y -> y.type), 'satellite_types', transform(filter(q, y -> y.gc = s.gc AND y.n <> s.n), y -> y.type), 'all_tags', {_tags()}, 'max_n', s.n, 'max_gc', s.gc, 'is_plain', false, 'char_count', x.a, 'para_count', x.e)",
    )
    bare = "forall(x.b, e -> e.count = 0) OR forall(x.b, e -> e.group_count = 0)"
    whole = let(qualified, "q", f"if({bare}, {of_plain(plain)}, if(size(q) = 0, {of_plain(repr(C.PLAIN))}, {structured}))")
    # masks are laid once more for effective paragraphs, so only where these are asked for
    asked = applied(f"x -> {bare.replace('x.b', 'x')}", found) & (F.length(text) >= SHORT)
    return applied(f"x -> {whole}", F.length(text), found, reasons, F.when(asked, count_effective_paragraphs(text)), count_paragraphs(text))


def split_types(rep: Column) -> Column:
    """The report's tags: spine and satellite types first, then the others."""
    return applied("r -> array_union(filter(concat(r.spine_types, r.satellite_types), t -> array_contains(r.all_tags, t)), r.all_tags)", rep)
