"""Masks for numbers that do not structure a text.

`mask` keeps the length of the text, so offsets hold in both; `tokens` puts a tag in the place of each match.
The rules are applied in order by a fold over the catalogue; of the rules, only those that a text can need.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseframe.functions.catalog import FLAGS, HAN_MARK, MASK_RULES
from clauseframe.functions.sql import applied, raw


def needed(pattern: str) -> str:
    """What a text must hold for a rule ever to match: the pattern without its looks around, which masks may change.

    Lazy tails and Han runs are left out too, as a mask may stand in them.
    """
    out, depth, i = [], 0, 0
    while i < len(pattern):
        if depth or re.match(r"\(\?<?[!=]", pattern[i:]):
            inside = re.match(r"\\.|\[(?:\\.|[^\]])*\]", pattern[i:])
            i += inside.end() if inside else 1
            depth += 0 if inside else {"(": 1, ")": -1}.get(pattern[i - 1], 0)
            continue
        out.append(pattern[i])
        i += 1
    return "".join(out).replace(r"[\s\S]*?", "").replace("[一-鿿]+", "")


def _literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, as far as it can be read off; maybe none."""
    parts = re.findall(r"\((?:\\.|\[(?:\\.|[^\]])*\]|[^()])*\)[?*+]?|\[(?:\\.|[^\]])*\][?*+]?(?:\{[^}]*\})?|\\.[?*+]?(?:\{[^}]*\})?|.[?*](?!\w)|.\{[^}]*\}|.", pattern)
    if "|" in parts:
        return ""
    runs = "".join(p if len(p) == 1 and p not in "?*+^$." else "\0" for p in parts).split("\0")
    return max(runs, key=len)


def _atoms(pattern: str) -> list[str]:
    """The parts of a pattern that has no looks around: characters, classes and groups, each with what repeats it."""
    return re.findall(r"(?:\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|\[(?:\\.|[^\]])*\]|\\.|\||.)(?:[?*+]|\{[^}]*\})*", pattern)


def _digits(pattern: str) -> list[str]:
    """Digits in a row of which every match of a pattern holds some; none, if that can't be read off."""
    pattern = re.sub(r"(.)\{(\d+),?\}", lambda m: m[1] * int(m[2]) if m[1].isdigit() else m[0], re.sub(r"^\(\?:(.*)\)$", r"\1", pattern))
    heads = [re.match(r"\d{2,}(?![?*{])", branch) for branch in re.sub(r"\((?:[^()])*\)", "(", pattern).split("|")]
    return [m[0] for m in heads] if all(heads) else []


def _some(pattern: str) -> str:
    """Characters of which every match of a pattern holds at least one, as few and as telling as can be read off; none, if only digits and blanks are sure."""
    branches = [[]]
    for atom in _atoms(pattern):
        if atom == "|":
            branches.append([])
        else:
            branches[-1].append(atom)
    found = []
    for branch in branches:
        sets = [s for s in map(_of_atom, branch) if s]
        if not sets:
            return ""
        found.append(min(sets, key=lambda s: (sum(len(_USUAL) - _USUAL.index(c) for c in s if c in _USUAL), len(s))))
    return "".join(dict.fromkeys("".join(found)))


def _of_atom(atom: str) -> str:
    if re.search(r"(?:[?*]|\{0[^}]*\})$", atom) and not re.fullmatch(r"\\.", atom):
        return ""  # may be absent
    atom = re.sub(r"(?:[+]|\{[^}]*\})+$", "", atom) if len(atom) > 1 else atom
    if atom.startswith("("):
        return _some(re.sub(r"^\((?:\?:)?", "", atom)[:-1])
    if atom.startswith("["):
        inside = atom[1:-1]
        if inside.startswith("^") or re.search(r"\\[dswDSW]", inside):
            return ""
        spans = "".join(map(chr, (c for x, y in re.findall(r"([^\\])-([^\]])", inside) for c in range(ord(x), ord(y) + 1))))
        return spans + re.sub(r"[^\\]-[^\]]", "", inside).replace("\\", "")
    if atom.startswith("\\"):
        return atom[1] if not atom[1].isalnum() else ""
    return atom if not atom.isdigit() and atom not in "^$." else ""


#: Characters that texts often hold, so that they tell little; the most usual ones first.
_USUAL = "第条一二三四五六七八九十章节，。 （）()、分."


def _fold(rules, step: str) -> str:
    # patterns given as literals are compiled once; a text without a character that a rule needs isn't searched for it
    found, bare, asked = [], [], ""
    for tag, han, pattern in rules:
        must = needed(pattern)
        some, literal = _some(must), _literal(must)
        any_of = [literal] if len(literal) > 1 else (some if len(some) < 12 else "") or _digits(must)
        held = [f"({' OR '.join(f'contains(x, {raw(c)})' for c in any_of)})"] if any_of else []
        rule = f"if({' AND '.join([*held, f'regexp_like(x, {raw(FLAGS + must)})'])}, named_struct('p', {raw(FLAGS + pattern)}, 'h', {str(han).lower()}, 't', '{tag}'), null)"
        found.append(rule)
        if set(some) <= set(_USUAL):
            bare.append(rule)
        else:
            asked += some
    # a text without any of these characters needs the other rules only
    asked = raw("".join(dict.fromkeys(asked)))
    of = lambda some: f"array_compact(array({', '.join(some)}))" if some else "cast(array() AS array<struct<p:string,h:boolean,t:string>>)"
    return f"x -> aggregate(if(translate(x, {asked}, '') = x, {of(bare)}, {of(found)}), x, (acc, r) -> if(regexp_like(acc, r.p), {step}, acc))"


def mask(text: Column, rules=MASK_RULES) -> Column:
    """Every match becomes underscores of its length; rules that keep the Han class begin with a Han character."""
    blot = f"if(r.h, concat('{HAN_MARK}', repeat('_', length(m) - 1)), repeat('_', length(m)))"
    return applied(_fold(rules, f"array_join(zip_with(split(acc, r.p, -1), regexp_extract_all(acc, r.p, 0), (p, m) -> concat(p, coalesce({blot}, ''))), '')"), text)


def tokens(text: Column, rules=MASK_RULES) -> Column:
    """Every match becomes its rule's token, as effective paragraphs are counted by them."""
    return applied(_fold(rules, f"regexp_replace(acc, r.p, concat(if(r.h, '{HAN_MARK}', ''), '___PB_', r.t, '_1___'))"), text)


def count_effective_paragraphs(text: Column) -> Column:
    """Lines that are not blank and not one token; 1 at least."""
    token = raw(FLAGS + r"^\s*___PB_\w+_\d+___\s*$")
    blank = raw(FLAGS + r"\S")
    return applied(rf"t -> greatest(size(filter(split(t, '\n', -1), x -> regexp_like(x, {blank}) AND NOT regexp_like(x, {token}))), 1)", tokens(text))


def restore(masked: Column, original: Column, start: Column, end: Column) -> Column:
    """The original text of a span of the masked text."""
    return F.substring(original, start + 1, end - start)
