"""The catalogue: mask rules, marker types and their guards, as data.

Patterns are written for Java regular expressions; FLAGS makes classes Unicode-aware and a line feed the only
line end, so that they mean the same in other engines.
"""

from __future__ import annotations

FLAGS = "(?Ud)"

#: Stands at the beginning of a mask that follows or precedes text as a Han character would.
HAN_MARK = "龘"
BLANKS = " \t\n\r　 "

# The mask rules in order of application, as (tag, keeps the Han class at its left edge, pattern).
MASK_RULES: list[tuple[str, bool, str]] = [
    ("BUYI", False, r"不\s*一"),
    ("MOKUAI", False, r"(?<!\d)\d+\s*模块"),
    ("LEI", False, r"(?<!\d)\d+\s*类(?!别|型|似|比)"),
    ("ZI", False, r"(?<!\d)\d+\s*字"),
    ("TRRILION", False, r"(?<!\d)\d+\s*亿元"),
    ("PIAN", False, r"(?<!\d)\d+\s*篇"),
    ("FJ1", False, r"附\s*\d+"),
    ("ZHONG", False, r"(?<!\d)\d+\s*种(?!类|族)"),
    ("TAO", False, r"(?<!\d)\d+\s*套"),
    ("MILIGRAM", False, r"(?<!\d)\d+\s*毫克"),
    ("CHANGZIMU", False, r"\d+[A-Za-z]+"),
    ("MILILITER", False, r"(?<!\d)\d+\s*毫升"),
    ("KE", False, r"(?<!\d)\d+\s*克(?!服|制)"),
    ("XIAOSHI", False, r"(?<!\d)\d+\s*小时"),
    ("DATE", False, r"二[〇零][二一二三四五六七八九]{2}年[一二三四五六七八九十]+月(?:[一二三四五六七八九十]+日)?|\d{4}\s*年\s*\d{1,2}\s*月\s*(?:\d{1,2}\s*日)?|\d{4}[-/]\d{1,2}[-/]\d{1,2}|自\s*\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日起施行|\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日\s*至\s*\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"),
    ("DOC", False, r"[\[〔]\s*\d{4}\s*[\]〕]\s*\d+\s*号|[一-鿿]+[\[〔]\d{4}[\]〕]\d+号"),
    ("PHONE", False, r"(?<!\d)(?:0\d{2,3}[-]\d{7,8}|\d{3}[-]\d{4}[-]\d{4}|\d{11})(?!\d)"),
    ("CONTACT", False, r"[零一二三四五六七八九十百千万亿两〇廿卅卌]+、\s*(?:联系方式|联系人|联系电话|电话|传真|电子邮箱|邮箱|联系地址|地址)[\s\S]*?(?=\n\s*[零一二三四五六七八九十百千万亿两〇廿卅卌]+、|\n\s*第[零一二三四五六七八九十百千万亿两〇廿卅卌]+[章条编节]|\z)"),
    ("YEAR", False, r"(?:19|20)\d{2}\s*年"),
    ("SY", False, r"(?<!\d)\d\s*年(?!度)"),
    ("YR", False, r"(?<!\d)(?:19(?:4[9]|[5-9]\d)|20[0-2]\d|2030)(?!\d)"),
    ("VER", True, r"(?:年版的|本版的|见)\s*\d+(?:\.\d+)+"),
    ("HAO", False, r"(?<!\d)\d+\s*号"),
    ("PCT", False, r"\d+\.?\d*\s*[‰%]"),
    ("FRAC", False, r"(?<!\d)\d+\s*/\s*\d+(?=\s*(?:万|千|百|十|[一-鿿]|[,，。；;、]|$))"),
    ("UNIT", False, r"\d+(?:\.\d+)?\s*[万米座个名次元]"),
    ("MD", False, r"\d{1,2}\s*月\s*\d{1,2}\s*日"),
    ("MO", False, r"(?<!\d)(?:1[0-2]|[1-9])\s*月"),
    ("QT", False, r"(?<!\d)[1-4]\s*季度"),
    ("RANGE", False, r"\d+\s*至"),
    ("ITEM", False, r"\d+\s*项"),
    ("MIN", False, r"\d+\s*分(?!类)"),
    ("PR", False, r"[）)]\s*[至项]"),
    ("TX", True, r"(?<!\d)\d+\s*表"),
    ("XT", True, r"表\s*\d+"),
    ("FJ", True, r"附件\s*\d+"),
    ("TY", True, r"统\s*一"),
    ("HY", True, r"合\s*一"),
    ("MM", False, r"\d+(?:\.\d+)?\s*mm"),
    ("TC", False, r"-?\d+(?:\.\d+)?\s*(?:°C|℃)"),
    ("DEG", False, r"-?\d+(?:\.\d+)?\s*°"),
    ("AM", True, r"\d+\s*′"),
    ("HRC", False, r"\d+\s*HRC"),
    ("MPA", False, r"\d+(?:\.\d+)?\s*MPa"),
    ("M", False, r"\d+(?:\.\d+)?\s*m(?!m|in)"),
    ("CM", False, r"\d+(?:\.\d+)?\s*cm"),
    ("DM", False, r"\d+(?:\.\d+)?\s*dm"),
    ("UM", False, r"\d+(?:\.\d+)?\s*μm"),
    ("H", False, r"\d+\s*h\b"),
    ("MIN2", True, r"\d+\s*min\b"),
    ("FIG", True, r"图\s*\d+(?:\.\d+)*(?:\s*[-–—]\s*\d+(?:\.\d+)*)?"),
    ("PX", True, r"\d+\s*部分"),
    ("KG", True, r"\d+(?:\.\d+)?\s*千克"),
    ("TON", True, r"\d+(?:\.\d+)?\s*吨"),
    ("WITHIN", False, r"\d+\s*[日月年周]\s*内"),
    ("DAY", False, r"\d+\s*天(?!气|然|津)"),
    ("TAI", True, r"(?<!\d)\d+(?:\.\d+)?\s*台(?!式|灯|风|高|号|阶|历|账|下|词|内|面)"),
    ("DE", True, r"\d+(?:、\s*\d+)+"),
    ("DI", True, r"第[一二三四五六七八九十]+(?:、第[一二三四五六七八九十]+)*、第"),
    ("LV", True, r"(?<!\d)\d+\s*级"),
    ("M1", True, r"m\d+"),
    ("BT", False, r"(?<!\d)\d+\s*瓶"),
    ("FML", False, r"(?<!\d)\d+\s*家(?!庭|用|园|务|人|乡|长|属)"),
    ("PER", False, r"(?<!\d)\d+\s*人"),
    ("PLC", False, r"(?<!\d)\d+\s*处"),
    ("PM", False, r"[+-][一二三四五六七八九十\d]+"),
    ("DU", False, r"(?<!\d)\d+(?:\.\d+)?\s*度"),
    ("U2", False, r"(?<!\d)\d+\s*[份件箱块位]"),
    ("COND", True, r"条件[：:]?\s*\d+(?!\.)"),
    ("BRENUM", True, r"[（(][一二三四五六七八九十]+[）)](?:、[（(][一二三四五六七八九十]+[）)])+、?"),
    ("ZHANG", False, r"(?<!\d)\d+\s*张"),
    ("AGE", False, r"(?<!\d)\d+\s*岁"),
    ("ZL", True, r"专栏\d+"),
    ("ZX", True, r"专项\d+"),
    ("HXNX", False, r"H\d+N\d+"),
    ("BTCH", False, r"(?<!\d)\d+\s*批"),
    ("TM", False, r"(?<!\d)\d+(?:\.\d+)?\s*倍"),
    ("JI", False, r"(?<!\d)\d+\s*剂(?!量)"),
    ("ZPAD", False, r"0{2,}\d+"),
    ("JY", True, r"均\s*一"),
    ("WY", True, r"唯\s*一"),
    ("KM", True, r"科目[一二三四五六七八九十\d]+"),
    ("ROMAN", True, r"(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+|(?<![A-Za-z_])[IVXLCDM]+(?![A-Za-z_]))"),
    ("LIE", True, r"第\s*\d+\s*列"),
    ("KUAN", True, r"第\s*[一二三四五六七八九十\d]+\s*款"),
    ("DJIE", True, r"第\d+(?:\.\d+)+\s*节"),
    ("DUAN", True, r"第\s*[一二三四五六七八九十\d]+\s*段"),
]

_CN = "([零一二三四五六七八九十百千万]+)"
_N = r"(\d+)"
_DOTS = r"(\d+(?:[.．]\d+)*)"
_AFTER_DOTS = r"(?!\s*[)）\]〝｝」』›»」])(?=\s|[一-鿿]|[（(《〈‘“「『]|$)"

# The marker types in order, as (name, kind of ordinal, pattern with one group).
# The kinds: cn (Chinese numeral), n (digits), dots (digits by dots), one (always 1).
MARKERS: list[tuple[str, str, str]] = [
    ("条", "cn", f"第{_CN}条"),
    ("章", "cn", f"第{_CN}章"),
    ("节", "cn", f"第{_CN}节"),
    ("编", "cn", f"第{_CN}编"),
    ("部分", "cn", f"第{_CN}部分"),
    ("数字部分", "n", f"第{_N}部分"),
    ("要", "cn", f"{_CN}要"),
    ("篇", "cn", f"第{_CN}篇"),
    ("括号", "cn", f"[（(]{_CN}[）)]"),
    ("括号数字", "n", f"[（(]{_N}[）)]"),
    ("中文顿号", "cn", f"(?<!第){_CN}[、､](?!第)"),
    ("数字顿号", "n", f"{_N}[、､]"),
    ("数字条", "dots", f"第{_DOTS}条"),
    ("数字章", "dots", f"第{_DOTS}章"),
    ("数字节", "dots", f"第{_DOTS}节"),
    ("数字点", "dots", rf"(\d+(?:[.．]\d+)+){_AFTER_DOTS}"),
    ("数字点点", "dots", rf"{_DOTS}[.．]{_AFTER_DOTS}"),
    ("数字直连中文", "n", r"(?<![.\d])(\d+)(?!\.\d)[　 ]?(?=[一-鿿A-Z])"),
    ("文书类型", "one", "《(规划|规定|意见|通知)》"),
    ("中文是", "cn", f"{_CN}是"),
    ("要素数字冒号", "n", f"要素{_N}[：:]"),
]
TYPES = [name for name, _, _ in MARKERS]

# Words and characters at the left that rule a marker out.
LEFT_OUT = r"(根据|[‘“「『《〈（\[(〔｢、，]|[过第单]|至少)$"
SEEN, OPINION = "见", "意"
ARTICLE_LEFT_OUT = "(将|作为|给|的|对|按|按规定|按规范|按标准|按准则|按要求|按法规|按规章|按条例)$"
ARTICLE_TYPES = ("条", "数字条")
RIGHT_GUARDED = ("数字点", "数字点点", "数字直连中文")
PAIRS = [(")", "("), ("]", "["), ("’", "‘"), ("”", "“"), ("」", "「"), ("』", "『"), ("》", "《"), ("〉", "〈"), ("）", "（"), ("〕", "〔"), ("｣", "｢")]
DOCUMENT_TYPE = "文书类型"
DOCUMENT_RIGHT_OUT = r"^\s*[’”」』》〉）)\]〕｣]"

# Types that are scored before they may cut.
SCORED = ("条", "数字条", "数字点", "数字点点", "数字直连中文", "数字节")
PLAIN, PLAIN_PARAGRAPHS = "纯文本", "纯文本段落拆分"
