"""What sentences claim, as Column expressions: signed percentages, what they refer to, values, times and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import TIME, strip
from .text import number

#: Words before a percentage, by what they make of it, in the order tried.
_FALL = "下降|减少|降低|下滑|回落|下跌"
_RISE = "增长|增加|提高|上升|上涨|提升"
_ABOUT = r"(?:了|约|大约|超过|接近)*\s*\z"
LEVEL = rf"(?:{_FALL}|{_RISE})(?:至|到|为){_ABOUT}"
MAGNITUDE = (
    r"(?:降幅|跌幅|下降幅度|减少幅度|降低幅度|下滑幅度|回落幅度|增幅|涨幅|增长幅度|增加幅度|提高幅度|上升幅度|上涨幅度|提升幅度)"
    r"(?:为|是|达到|约为|达|约|大约)*\s*\z"
)
DOWN = rf"(?:{_FALL}|负增长|缩减|萎缩){_ABOUT}"
UP = rf"(?:{_RISE}){_ABOUT}"
#: Fixed value: what ends a clause.
CLAUSE_END = r"[，,。；;！？!?\n]"
#: Expressions that point back, by kind, in the order tried.
REFERENCES = (
    ("entity_ref", "该(?:公司|企业|产品|单位|部门|项目|案例|方案|渠道|数据|指标|模式|系统|环节|阶段|周期)"),
    ("ordinal_ref", "前者|后者"),
    ("summary_ref", "综合(?:以上|上述)|综上所述|综上(?:所述)?|基于(?:上述|以上|此前)"),
    ("collective_ref", "这(?:些|几个|两个|三个|四个|五个)(?:案例|方案|项目|产品|渠道|类别|数据)?|以上(?:数据|分析|案例|方案)?"),
    ("named_ref", "(?:案例|方案|项目|渠道|产品)[A-E]"),
    ("transition_ref", "(?:很好|好的|现在|目前)(?:我们|，|,).{0,10}(?:有了|已经有|已获得)"),
    ("direct_ref", "上述|前述|前面(?:提到|计算|分析|讨论)的"),
    ("comparison_ref", "(?:对比|比较|相比|相对于?)以上"),
)
#: Known entities, metrics and constraints.
ENTITY = (
    "凤鸣大道[一二三]?期?|皖江路|上海|北京|广州|天津|深圳|直通车|钻展|淘客|名称[0-9]+|材料[0-9]+|产品[A-Z]|案例[A-E]|方案[A-E]|乘用车|商用车|女粉色反领夹棉|"
    "唐山市|西南石油大学|环球金融中心|中央电视台|银泰中心|金蝶EAS|天猫|淘宝"
)
METRIC = (
    "产量|销量|出口量|同比增长率|环比增长率|月还款|月供|总利息|成本占比|访客数|跳失率|转化率|ROI|投资|总投资|平均投资|单方造价|每公里造价|库存周转|响应时间|"
    "询单转化率|下单转化率|最高分|最低分|差异度|未完成率|平均价格|涨跌幅|库存周转压力系数|可支持天数"
)
CONSTRAINT = (
    r"(?:19\d{2}|20\d{2})\s*年(?:之前|之后|以来|间|之间|度|第[一二三四]季度)?|(?:19\d{2}|20\d{2})[-—](?:19\d{2}|20\d{2})|\d{1,2}\s*月(?:\s*(?:上旬|中旬|下旬|上半月|下半月))?"
    r"|(?:北京|上海|广州|深圳|天津|成都|武汉|杭州|南京|重庆)"
    r"|(?:不低于|不高于|不超过|至少|至少为|最少|最多|高于|低于|大于|小于|以上|以下)\s*\d+(?:\.\d+)?(?:\s*%|\s*元|\s*万|\s*亿)?"
)
#: Numbers with units, longer units first; percentages; texts that ask for a computation.
VALUE = r"\d+(?:[.,]\d+)*\s*(?:万元/公里|元/吨|元/公斤|%|万元|亿元|美元|欧元|人民币|辆|台|吨|公斤|克|公里|米|厘米|毫米|小时|分钟|秒|次|倍|个|人)?"
PERCENT = r"\d+(?:\.\d+)?\s*%"
COMPUTATION = (
    "(?:需|需要|须|应|可|请).{0,15}(?:计算|算出|求和|求平均|推导|换算|折算)|(?:计算|算出|求和|求平均|换算|折算).{0,15}(?:得出|得到|获得|的|后|来)"
    r"|(?:根据|基于|利用|通过).{0,20}(?:计算|算出|求和|求平均|换算|折算)|[计核]算\s*(?:同比|环比|增长|平均|占比|总|差|加权)|求\s*(?:和|平均值|平均|差|比值)"
)
_SIGNED = r"(-?)(\d+(?:\.\d+)?)\s*(%|％|个百分点|个百分比点)"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0))


def signed_percents(text: Column) -> Column:
    """array<struct<value double, unit, kind>>: each percentage with the sign that the words right before it, in its clause, give it.

    A written minus counts as it stands; a level that is reached and the size of a change stay positive; falls turn
    negative; elsewhere the kind is unknown. Null and empty texts: an empty array.
    """
    # What stands between two percentages of a clause is the later one's context.
    parts = F.flatten(F.transform(F.split(_text(text), CLAUSE_END), lambda c: F.regexp_extract_all(c, F.lit(f"(?s).*?{_SIGNED}"), F.lit(0))))

    def claim(part: Column) -> Column:
        of = lambda k: F.regexp_extract(part, f"(?s)^(.*?){_SIGNED}", k)
        before, size = of(1), of(3).cast("double")
        kind = F.when(of(2) == "-", "change").when(before.rlike(LEVEL), "level").when(before.rlike(MAGNITUDE), "magnitude").when(before.rlike(DOWN) | before.rlike(UP), "change").otherwise("unknown")
        negative = (of(2) == "-") | ((kind == "change") & before.rlike(DOWN))
        unit = F.when(F.contains(of(4), F.lit("百分点")), "percentage_point").otherwise("percent")
        return F.struct(F.when(negative, -size).otherwise(size).alias("value"), unit.alias("unit"), kind.alias("kind"))

    return F.transform(parts, claim)


def references(text: Column) -> Column:
    """array<struct<text, kind>>: distinct expressions that point back; one that two kinds match has the earlier kind."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(_all(text, pattern), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("kind")))

    found = F.concat(*[of(kind, pattern) for kind, pattern in REFERENCES])
    texts = F.transform(found, lambda r: r["text"])
    return F.filter(found, lambda r, i: F.array_position(texts, r["text"]) == i + 1)


def entities(text: Column) -> Column:
    return F.array_distinct(_all(text, ENTITY))


def metrics(text: Column) -> Column:
    return F.array_distinct(_all(text, METRIC))


def constraints(text: Column) -> Column:
    return F.array_distinct(_all(text, CONSTRAINT))


def times(text: Column) -> Column:
    """Every time expression, repeats too."""
    return _all(text, TIME)


def value_tokens(text: Column) -> Column:
    """Distinct numbers with their units, commas dropped, then percentages as written."""
    numbers = F.transform(_all(text, VALUE), lambda x: strip(F.regexp_replace(x, "[,，]", "")))
    return F.array_distinct(F.concat(numbers, _all(text, PERCENT)))


def computation(text: Column) -> Column:
    """The first words of a text that ask for a computation; null if none do."""
    return F.nullif(F.regexp_extract(_text(text), COMPUTATION, 0), F.lit(""))


def python_number(value: Column) -> Column:
    """A double as Python writes it: the fewest digits that tell it, an exponent below 1e-4 and from 1e16 on, `nan`, `inf`; null stays null.

    From 9.2e18 on and for subnormal numbers the last digit may differ where two of that length tell the number.
    """
    size = F.abs(value)
    tries = [F.format_string(f"%.{n}e", size) for n in (14, 15)]
    told = F.coalesce(*[F.when(x.cast("double") == size, x) for x in tries], F.format_string("%.16e", size))
    head, power = F.split_part(told, F.lit("e"), F.lit(1)), F.split_part(told, F.lit("e"), F.lit(2)).cast("int")
    # Formatting goes by 17 digits; between 1e16 and the largest long the integer itself is rounded.
    exact, whole_range = size.cast("long"), (size >= 1e16) & (size < 9.2e18)
    cut = lambda n: F.coalesce(*[F.when(F.length(exact.cast("string")) == m, F.round(exact, n - m)) for m in (17, 18, 19)])
    best = F.coalesce(*[F.when(cut(n).cast("double") == size, cut(n)) for n in (15, 16)], cut(17)).cast("string")
    head, power = F.when(whole_range, best).otherwise(head), F.when(whole_range, F.length(best) - 1).otherwise(power)
    digits = F.regexp_replace(F.replace(head, F.lit("."), F.lit("")), "(?<=.)0+$", "")
    n = F.length(digits)
    whole = F.when(n > power + 1, F.concat(F.left(digits, power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    mantissa = F.when(n > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
    far = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    plain = F.when((power >= 0) & (power < 16), whole).when((power < 0) & (power >= -4), small).otherwise(far)
    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(value), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(value.isNotNull(), F.concat(sign, plain))


def any_in(text: Column, words: Column) -> Column:
    """Whether one of an array of texts holds the text, whatever the case."""
    return F.coalesce(F.exists(words, lambda w: F.contains(F.lower(w), F.lower(text))), F.lit(False))


def normal_cell(cell: Column) -> Column:
    """A cell's text as a repaired grid shows it: numbers without separators, percentages as their hundredth, as Python writes them; null is empty, other texts stay, untrimmed."""
    bare, share = F.regexp_replace(F.trim(cell), "[,%]", ""), F.endswith(F.trim(cell), F.lit("%"))
    whole = F.when(bare.rlike(r"^[+-]?\d{1,38}$") & ~share, bare.try_cast("decimal(38,0)").cast("string"))
    shown = F.get(F.transform(F.array(number(cell)), python_number), F.lit(0))  # the number is worked out once
    return F.when(F.coalesce(cell, F.lit("")) == "", "").otherwise(F.coalesce(whole, shown, cell))
