from pyspark.sql import functions as F

from clauseframe.functions.ordinals import cn_to_int, get_ordinal, int_to_cn
from clauseframe.functions.text import clean_html, count_paragraphs
from clauseframe.operators import groups, mask


def column(spark, values, made, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(made(F.col("x"))).collect()]


def test_chinese_numerals(spark):
    given = {"一": 1, "十": 10, "二十": 20, "一百": 100, "一百零五": 105, "三千二百一十": 3210, "十二万三千": 123000, "二〇": 2, "一二": 2, "零": 0, "": 0}
    assert column(spark, list(given), cn_to_int) == list(given.values())


def test_numerals_there_and_back(spark):
    n = spark.range(1, 10000).select("id", cn_to_int(int_to_cn(F.col("id"))).alias("back"))
    assert n.where("id <> back").count() == 0


def test_ordinals_of_fragments(spark):
    given = {
        "第一条 甲": [1], "第十条 甲": [10], "第二十条 甲": [20], "第一百条 甲": [100], "无标记": None, "第一章 总则": [1], "第六章 附则": [6], "第一节 规定": [1], "5.1 总述": [5, 1],
        "6.1.1 细则": [6, 1, 1], "一、甲": [1], "四、甲": [4], "（一）甲": [1], "（六）甲": [6], "": None, "   ": None, "  第一条": None, "99999999999999999999、甲": None,
    }
    assert column(spark, list(given), get_ordinal) == list(given.values())


def test_cleaning(spark):
    given = {
        "<p>第一条 测试内容。</p>": "第一条 测试内容。", "第一条&nbsp;测试": "第一条 测试", "A &amp; B": "A & B", "X &lt; Y &gt; Z": "X < Y > Z", "  第一条 测试  ": "第一条 测试", "-、 甲": "一、 甲", "—、 甲": "一、 甲",
        "（-） 甲": "（一） 甲", "（—） 甲": "（一） 甲", "(-) 甲": "(一) 甲", "(—) 甲": "(一) 甲", "双方——甲方": "双方——甲方", "a  b\n\n\t c": "a b\nc", "&lt;法&gt;": "<法>", "": "", None: None,
    }
    assert column(spark, list(given), clean_html) == list(given.values())


def test_paragraphs(spark):
    assert column(spark, ["a\n\n b\n", "", "\n \n"], count_paragraphs) == [2, 0, 0]


def test_runs_and_restarts(spark):
    lists = [[1, 2, 3, 1, 2, 5, 3, 1, 7, 1], [2, 1], [1, 3, 2], [], [3, 4], [1, 2, 4, 3]]
    assert column(spark, lists, groups.restarts, "array<bigint>") == [[3, 3], [], [2], [], [], [3]]
    assert column(spark, lists, groups.longest_run, "array<bigint>") == [3, 2, 3, 0, 0, 4]


def test_masks_keep_length_and_class(spark):
    texts = ["自2025年1月1日起施行", "重5吨", "附1", "统一", "5.1 个人", "第1部分", "Ⅰ", "无", "", "见6.1.3条"]
    got = column(spark, texts, mask.mask)
    assert [len(g) for g in got] == [len(t) for t in texts]
    assert got[1] == "重龘_" and got[3] == "龘_" and got[4] == "_____人" and got[6] == "龘" and got[7] == "无"


def test_tokens(spark):
    assert column(spark, ["重5吨", "占3%"], mask.tokens) == ["重龘___PB_TON_1___", "占___PB_PCT_1___"]


def test_effective_paragraphs(spark):
    assert column(spark, ["甲\n2024年3月1日\n乙", ""], mask.count_effective_paragraphs) == [2, 1]


def test_skipping_rules_changes_nothing(spark):
    """Only the rules that a text can need are applied; with all of them the mask is the same."""
    import random

    from clauseframe.functions.catalog import MASK_RULES

    rng = random.Random(5)
    parts = "5吨|附件3|2024年3月1日|〔2020〕5号|国发|一、联系人：张|\n二、|第三章|10%|3/4万|m2|Ⅳ|IX|见6.1.2|0012|13812345678|统一|1、2、3|（一）、（二）|第一、第二、第|图3-1|不一|类别|3类|别|天|气|30 天|—|，|甲乙|科目一|H1N1|+3|条件：2|12月|5至|）至|-3°C|7台|式|100mm|第3.1节".split("|")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    fast = column(spark, texts, mask.mask)

    def slowly(text):
        always = mask.needed
        mask.needed = lambda pattern: ""
        try:
            return mask.mask(text, MASK_RULES)
        finally:
            mask.needed = always

    assert fast == column(spark, texts, slowly)


def test_a_text_is_searched_for_its_own_type(spark):
    """Looking for one type a row finds what all types' markers hold of it, whatever other types stand in the text."""
    from clauseframe.functions import catalog as C
    from clauseframe.operators import markers

    texts = ["第一条 甲\n（一）乙\n1.1 丙\n根据第二条", "三、甲（3）乙 《规定》 要素4：5甲", "见第五条 意见第六条", "", None]
    rows = spark.createDataFrame([(t, k) for t in texts for k in [*C.TYPES, "无", None]], "text string, kind string")
    one, whole = markers.raw_markers(F.col("text"), kind=F.col("kind")), markers.raw_markers(F.col("text"))
    got = rows.select("text", "kind", one.alias("one"), whole.alias("whole")).collect()
    assert all(r["one"] == (r["whole"] if r["kind"] is None or r["whole"] is None else [m for m in r["whole"] if m["type"] == r["kind"]]) for r in got)
    assert sum(len(r["one"] or ()) for r in got if r["kind"]) > 8


def test_rules_need_what_every_match_holds():
    """A text without a rule's characters isn't searched for it: whatever the rules match must hold them."""
    import re

    from clauseframe.functions.catalog import MASK_RULES
    from clauseframe.operators import mask
    from clauseframe.plans.queries import _MASKED

    text = "。" + "甲。".join(re.sub("«=?|»", "", case) for case in _MASKED) + "甲 见3.2 自2020年1月2日 2020/1/2 一、联系方式：甲 010-12345678 3MPa 3cm 3dm 3μm 3h 3min H2N3 图3-4 年版的3.2"
    hit = 0
    for tag, _, pattern in MASK_RULES:
        must = mask.needed(pattern)
        some, digits = mask._some(must), mask._digits(must)
        for m in re.finditer(pattern.replace(r"\z", r"\Z"), text):
            hit += 1
            assert not some or set(some) & set(m[0]), tag
            assert some or not digits or any(d in m[0] for d in digits), tag
        assert some or digits or tag == "PHONE", tag
    assert hit > 80


def test_short_sequences_are_looked_at_once():
    from clauseframe.functions import sql

    seen = []

    def f(items):
        seen.append(items)
        if 0 in items:
            raise ValueError("zero")
        return [(x, x > 1) for x in items]

    of = sql.remembered(f)
    assert [of((1, 2)), of((1, 2)), of((0,)), of((0,))] == [([(1, False), (2, True)], None)] * 2 + [(None, "ValueError: zero")] * 2 and seen == [(1, 2), (0,)]
    long = tuple(range(1, 100))
    assert of(long) == of(long) and seen[2:] == [long, long]  # what is long isn't kept
