"""Markers with positions, guards against false ones, and overlaps resolved.

Spans are found by a small vectorised function, as a marker's guards look at what stands around it in the text: a slice
of a string there, but a walk from the beginning of the text for every look in an expression. All else are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseframe.functions import catalog as C
from clauseframe.functions.ordinals import ordinal_sql
from clauseframe.functions.sql import applied, explained, grown, texts

MARKER = "struct<start:int,prio:int,less:int,seq:int,end:int,type:string,text:string,ord:array<bigint>>"
SPAN = "struct<start:int,end:int,seq:int,text:string,group:string>"
#: Whether a marker of a type is false, by the text before it and after it.
Guard = Callable[[str, str, str], bool]
#: What rules a marker out ends at most so many characters before it, blanks aside.
NEAR = 4
#: The last characters of what rules markers out on the left, and the closing ones of those on the right.
_LEFT_ENDS, _RIGHTS = "据‘“「『《〈（[(〔｢、，过第单少", frozenset(right for right, _ in C.PAIRS)
#: A character that every marker of a type holds; a text without it isn't searched.
_HOLDS = {"数字部分": "部", "部分": "部", "括号": "（(", "括号数字": "（(", "中文顿号": "、､", "数字顿号": "、､", "数字条": "条", "数字章": "章", "数字节": "节", "数字点": ".．", "数字点点": ".．", "数字直连中文": "", "文书类型": "《", "中文是": "是", "要素数字冒号": "素"}
_PRIORITY = {"数字直连中文": 0, "数字点": 1, "数字点点": 1}


@lru_cache(maxsize=1)
def _patterns():
    found = [re.compile(pattern) for _, _, pattern in C.MARKERS]
    left, article = map(re.compile, (C.LEFT_OUT, C.ARTICLE_LEFT_OUT))
    return found, left, article, re.compile(r"\s*[条章节]"), re.compile(C.DOCUMENT_RIGHT_OUT.lstrip("^"))


class _Guards:
    """What rules out markers of one text."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def _begins(self) -> tuple[int, int, int]:
        """What the beginning of a text says about every article is looked up once."""
        return self.text.find("\n"), self.text.find("按《"), self.text.find("按（")

    def _trimmed(self, start: int, blanks: str | None) -> int:
        """Where the text before a place ends, without blanks."""
        low = max(0, start - 64)  # mostly it is near; else the whole text before is looked at
        left = self.text[low:start].rstrip(blanks)
        return low + len(left) if left or not low else len(self.text[:low].rstrip(blanks))

    def _of_article(self, start: int, article: re.Pattern) -> bool:
        end = self._trimmed(start, None)
        if not end:
            return False
        last = self.text[end - 1]
        if last in "法》）":
            line, book, bracket = self._begins
            if last == "法" and end > 2 and self.text[0] == "按" and not 0 < line < end:
                return True
            if last == "》" and 0 <= book <= end - 2 or last == "）" and 0 <= bracket <= end - 2:
                return True
        return bool(article.search(self.text[max(0, end - NEAR) : end]))

    def out(self, name: str, start: int, end: int) -> bool:
        _, left_out, article, right_out, document = _patterns()
        to = self._trimmed(start, C.BLANKS) if start else 0
        if to and self.text[to - 1] in _LEFT_ENDS and left_out.search(self.text[max(0, to - NEAR) : to]):
            return True
        if to and self.text[to - 1] == C.SEEN and self.text[max(0, self._trimmed(to - 1, C.BLANKS) - 1) : to - 1].rstrip(C.BLANKS) != C.OPINION:
            return True
        if to and name in C.ARTICLE_TYPES and self._of_article(start, article):
            return True
        if name in C.RIGHT_GUARDED:
            five = self.text[end : end + 5]
            if not _RIGHTS.isdisjoint(five):
                for right, opening in C.PAIRS:
                    at, before = five.find(right), five.find(opening)
                    if at >= 0 and not 0 <= before < at:
                        return True
            if right_out.match(self.text, end):
                return True
        return name == C.DOCUMENT_TYPE and bool(document.match(self.text, end))


def _finder(types: frozenset | None, guard: bool, extra: Guard | None) -> Callable[..., tuple[list | None, str | None]]:
    """A text's markers as (start, prio, less, seq, end, text, group), sorted, and null; or null and the error. Given a type too, those of that type."""
    searched = [(seq, name, _HOLDS.get(name, name), _PRIORITY.get(name, 2), pattern) for seq, (name, pattern) in enumerate(zip(C.TYPES, _patterns()[0])) if types is None or name in types]
    by_type = {name: [one] for one in searched for name in one[1:2]}

    @explained
    def of_text(text: str, kind: str | None = None):
        own, guards = [], None
        for seq, name, holds, prio, pattern in searched if kind is None else by_type.get(kind, ()):
            if holds and holds[0] not in text and (len(holds) < 2 or holds[1] not in text):
                continue
            for m in pattern.finditer(text):
                start, end = m.span()
                if guard:
                    guards = guards or _Guards(text)
                    if guards.out(name, start, end):
                        continue
                if extra and extra(name, text[:start], text[end:]):
                    continue
                own.append((start, prio, start - end, seq, end, m[0], m[1]))
        own.sort()
        return own

    return of_text


def _spans(types: frozenset | None, guard: bool, extra: Guard | None, typed: bool):
    def found(rows_of_texts):
        of_text = _finder(types, guard, extra)
        sizes, rows, none, errors = [0], [], [], []
        for text, *kind in rows_of_texts:
            own, error = of_text(text, *kind) if text else (None if text is None else [], None)
            none.append(own is None)
            errors.append(error)
            rows += own or []
            sizes.append(len(rows))
        start, _, _, seq, end, whole, group = zip(*rows) if rows else ((),) * 7
        parts = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(seq, pa.int32()), pa.array(whole, pa.string()), pa.array(group, pa.string())]
        spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "end", "seq", "text", "group"]), mask=pa.array(none) if any(none) else None)
        return pa.StructArray.from_arrays([spans, pa.array(errors, pa.string())], ["spans", "error"])

    def run(texts):
        return found((t,) for t in texts.to_pylist())

    def run_typed(texts, kinds):
        return found(zip(texts.to_pylist(), kinds.to_pylist()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    run_typed.__annotations__ = {"texts": pa.Array, "kinds": pa.Array, "return": pa.Array}
    return F.arrow_udf(run_typed if typed else run, f"spans array<{SPAN}>, error string").asNondeterministic()  # so that the optimizer leaves it outside lambdas


ROW = "start int, prio int, less int, seq int, end int, text string, group string"
_ROW_KINDS = [pa.int32()] * 5 + [pa.string()] * 2


def marker_rows(docs: DataFrame, id_col: str = "law_id", text: str = "text", types=None, guard: bool = True, extra: Guard | None = None) -> DataFrame:
    """A row (id, start, prio, less, seq, end, type, text, ord) for each marker, for texts whose markers don't fit one row. Documents that fail give none."""
    of_text = _finder(None if types is None else frozenset(types), guard, extra)

    def run(batches):
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                own, _ = of_text(t) if t else (None, None)
                for at in range(0, len(own or ()), 10_000):
                    part = own[at : at + 10_000]
                    columns = [pa.array(c, k) for c, k in zip(zip(*part), _ROW_KINDS)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part), pa.int64())), *columns], ["id", *(f.split()[0] for f in ROW.split(", "))])

    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {ROW}")
    names, kinds = texts(C.TYPES), texts([kind for _, kind, _ in C.MARKERS])
    columns = [F.col("id").alias(id_col), "start", "prio", "less", "seq", "end", F.expr(f"{names}[seq]").alias("type"), "text", F.expr(ordinal_sql(f"{kinds}[seq]", "group")).alias("ord")]
    return found.select(*columns).where("ord IS NOT NULL")


def raw_markers(text: Column, types=None, guard: bool = True, extra: Guard | None = None, kind: Column | None = None) -> Column:
    """All markers of the given types (unknown names are ignored), sorted by start, priority, length and type order.

    extra(type, left, right) may rule out more markers, by the text on either side; null for a text on which it fails.
    kind: the only type that is looked for in a row's text (all, where it is null).
    """
    return ordered(found_spans(text, types, guard, extra, kind)["spans"])


def found_spans(text: Column, types=None, guard: bool = True, extra: Guard | None = None, kind: Column | None = None) -> Column:
    """The spans of raw_markers, for `ordered`, and the error of a text on which it fails."""
    found = _spans(None if types is None else frozenset(types), guard, extra, kind is not None)
    return found(text) if kind is None else found(text, kind)


def type_sequence(text: Column, types: list[str]) -> Column:
    """The types of all matches in order of place: without guards, and with those that overlap."""
    found = F.filter(found_spans(text, types, guard=False)["spans"], lambda s: s["seq"] >= 0)
    return applied(f"ss -> transform(ss, s -> {texts(C.TYPES)}[s.seq])", F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["seq"]))))


def ordered(spans: Column) -> Column:
    """Sorted spans as markers, without those whose ordinal can't be read."""
    names, kinds = texts(C.TYPES), texts([kind for _, kind, _ in C.MARKERS])
    prios = f"array({', '.join(str(_PRIORITY.get(t, 2)) for t in C.TYPES)})"
    marker = f"named_struct('start', m.start, 'prio', {prios}[m.seq], 'less', m.start - m.end, 'seq', m.seq, 'end', m.end, 'type', {names}[m.seq], 'text', m.text, 'ord', {ordinal_sql(f'{kinds}[m.seq]', 'm.group')})"
    return applied(f"ms -> filter(transform(ms, m -> {marker}), m -> m.ord IS NOT NULL)", spans)


def without_overlaps(markers: Column) -> Column:
    """In order, each marker that begins after the last kept one ends."""
    # where no marker overlaps the one before it, all stay
    clear = "forall(sequence(1, greatest(size(ms) - 1, 1)), i -> coalesce(get(ms, i).start >= ms[i - 1].end, true))"
    return applied("ms -> if(size(ms) < 2, ms, if(" + clear + ", ms, " + grown(MARKER, "ms", {"end": "0"}, {"end": "if(x.start >= a.end, x.end, a.end)"}, "x", "x.start >= a.end") + "))", markers)
