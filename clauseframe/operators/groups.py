"""Statistics of each marker type: runs, restarts, dotted groups, suppression."""

from __future__ import annotations

from pyspark.sql import Column

from clauseframe.functions import catalog as C
from clauseframe.functions.sql import applied, grown, let, raw, texts


def _longest(ords: str) -> str:
    return f"aggregate(array_sort(array_distinct({ords})), 0L, (a, x) -> if(x = a + 1, x, a), a -> if(a >= 2, a, 0L))"


def _restarts(ords: str) -> str:
    return grown("bigint", ords, {"at": "0L"}, {"at": "if(x = 1 OR a.at > 0 AND x = a.at + 1, x, a.at)"}, "a.at", "x = 1 AND a.at >= 2", "if(a.at >= 2, a.at, null)")


def longest_run(ords: Column) -> Column:
    """N of the longest 1..N among the distinct values; 0 below 2."""
    return applied(f"o -> {_longest('o')}", ords)


def restarts(ords: Column) -> Column:
    """The ends of the runs 1, 2, 3 ... in order: a 1 begins a run, repeats and gaps are skipped, runs of one are dropped."""
    return applied(f"o -> {_restarts('o')}", ords)


def entries(markers: Column) -> Column:
    """A struct of statistics for every type of the catalogue, in its order."""
    head = "slice(o, 1, size(o) - 1)"
    of_prefix = let(f"transform(filter(d.dotted, o -> {head} = p), o -> element_at(o, -1))", "l", f"named_struct('prefix', p, 'n', {_longest('l')}, 'ends', {_restarts('l')})")
    tuples = f"filter(transform(array_distinct(transform(d.dotted, o -> {head})), p -> {of_prefix}), q -> q.n >= 3)"
    statistics = f"""named_struct('type', t, 'count', size(own), 'ordinals', transform(own, m -> m.ord), 'positions', transform(own, m -> named_struct('start', m.start, 'end', m.end)),
        'scalar_groups', g.ends, 'tuple_groups', flatten(transform(g.tuples, p -> transform(p.ends, e -> named_struct('less', -e, 'prefix', p.prefix, 'hi', e)))),
        'max_n', cast(greatest({_longest('d.scalars')}, coalesce(array_max(transform(g.tuples, p -> p.n)), 0L)) AS int),
        'group_count', cast(if(t = '{C.DOCUMENT_TYPE}' AND size(own) > 0, size(own), size(g.ends)) + aggregate(g.tuples, 0, (a, p) -> a + size(p.ends)) AS int))"""
    split = "named_struct('scalars', transform(filter(own, m -> size(m.ord) = 1), m -> m.ord[0]), 'dotted', transform(filter(own, m -> size(m.ord) > 1), m -> m.ord))"
    entry = let("filter(ms, m -> m.type = t)", "own", let(split, "d", let(f"named_struct('ends', {_restarts('d.scalars')}, 'tuples', {tuples})", "g", statistics)))
    # most types have no marker in a text
    kinds = {"ordinals": "array<array<bigint>>", "positions": "array<struct<start:int,end:int>>", "scalar_groups": "array<bigint>", "tuple_groups": "array<struct<less:bigint,prefix:array<bigint>,hi:bigint>>"}
    none = ", ".join(f"'{k}', cast(array() AS {kind})" for k, kind in kinds.items())
    nones = f"array({', '.join(f'named_struct({chr(39)}type{chr(39)}, {raw(t)}, {chr(39)}count{chr(39)}, 0, {none}, {chr(39)}max_n{chr(39)}, 0, {chr(39)}group_count{chr(39)}, 0)' for t in C.TYPES)})"
    each = f"transform({nones}, z -> if(array_contains(there, z.type), {let('z.type', 't', entry)}, z))"
    return applied("ms -> " + let("if(ms IS NULL, null, array_distinct(transform(ms, m -> m.type)))", "there", f"if(there IS NULL, null, {each})"), markers)


def group_labels(entry: Column) -> Column:
    """The groups of a type as 1-5, or 6.1.1-3 below a prefix; those of dotted numbers with the longest first."""
    dotted = "transform(array_sort(e.tuple_groups), g -> concat(array_join(cast(g.prefix AS array<string>), '.'), if(size(g.prefix) > 0, '.', ''), '1-', g.hi))"
    return applied(f"e -> concat(transform(e.scalar_groups, n -> concat('1-', n)), {dotted})", entry)


def first_ordinals(entry: Column, n: int = 8) -> Column:
    """The first ordinals of a type as text, and how many more there are."""
    shown = f"array_join(transform(slice(e.ordinals, 1, {n}), o -> array_join(cast(o AS array<string>), '.')), ', ')"
    return applied(f"e -> concat({shown}, if(size(e.ordinals) > {n}, concat(' (+', size(e.ordinals) - {n}, ')'), ''))", entry)


# The parents that can hold a type, in order.
_DIGIT_PARENTS = ("中文顿号", "条", "括号", "括号数字", "数字点", "数字点点")
_ARTICLE_PARENTS = ("中文顿号", "括号", "括号数字", "数字点", "数字点点")


def suppressions(found: Column) -> Column:
    """A reason or null for every type, in the catalogue's order. Spans tile from a parent's first marker to the end of the text."""
    at = {t: f"e[{i}]" for i, t in enumerate(C.TYPES)}
    first = lambda t: f"array_min({at[t]}.positions.start)"
    # more than half of a type's markers begin at or after a place
    after = lambda t, place: f"coalesce(2 * size(filter({at[t]}.positions, p -> p.start >= {place})) > {at[t]}.count, false)"
    article, digits = (at[t] for t in C.ARTICLE_TYPES)
    reasons: dict[str, str] = {}
    for name in ("数字点", "数字点点"):
        reasons[name] = f"if(({article}.max_n >= 3 OR {digits}.max_n >= 3) AND {at[name]}.count > 0 AND {after(name, f'least({first(C.ARTICLE_TYPES[0])}, {first(C.ARTICLE_TYPES[1])})')}, '条内抑制', null)"
    for name, parents, label, allowed in (("数字顿号", _DIGIT_PARENTS, "包容抑制", "true"), ("条", _ARTICLE_PARENTS, "条包裹抑制", f"{article}.max_n <= 4")):
        tests = [f"if({allowed} AND {at[name]}.count > 0 AND {at[p]}.count >= 2 AND {after(name, first(p))}, '{label}({p})', null)" for p in parents]
        reasons[name] = f"coalesce({', '.join(tests)})"
    return applied(f"e -> array({', '.join(reasons.get(t, 'cast(null AS string)') for t in C.TYPES)})", found)
