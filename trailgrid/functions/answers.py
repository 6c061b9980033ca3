"""Texts that models write, as Column expressions: lenient JSON, tagged parts, answers, amounts and their checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import full_to_half

#: Unit suffixes with a factor, in the order tried, and unit characters dropped at the end.
AMOUNT_SUFFIXES = (
    ("万元/公里", 1e4), ("亿元/公里", 1e8), ("万元/吨", 1e4), ("元/吨", 1.0), ("亿元", 1e8), ("万元", 1e4), ("美元", 1.0), ("欧元", 1.0),
    ("亿", 1e8), ("万", 1e4), ("千", 1e3), ("百", 1e2),
)
AMOUNT_UNITS = "元个辆台吨公斤克公里米厘米毫米小时分钟秒次倍人/"
#: Fixed value: a number with its magnitude and unit.
AMOUNT = r"(-?\d+(?:[.,]\d+)*\s*(?:亿|万|千|百)?\s*(?:%|元|万元|亿元|美元|欧元|辆|台|吨|公斤|克|公里|米|厘米|毫米|小时|分钟|秒|次|倍|个|人)?)"
#: Fixed value: a time expression.
TIME = (
    r"(\d{4}\s*年\s*(?:\d{1,2}\s*月(?:\s*(?:上旬|中旬|下旬|上半月|下半月|初|底|末))?)?"
    r"|\d{1,2}\s*月(?:\s*(?:上旬|中旬|下旬|上半月|下半月|初|底|末))?|\d{4}\s*年第[一二三四季度]|\d{4}年(?:\d{1,2}月)?\d{1,2}日)"
)
#: Headings after which an answer stands.
ANSWER_HEADINGS = ("**Answer:**", "## Answer", "### Answer", "## Response", "### Response", "Answer:")
#: Commands that are refused.
REFUSED = (
    r"\brm\s+(-rf?|--recursive)\s+[/\\]", r"\bdel\s+[/\\]\*", r"\bformat\s+[a-zA-Z]:", r"\bmkfs\b", r"\bdd\s+.*of=/dev/", r"\bsudo\s+", r"\bsu\s+", r"\brunas\b", r"\bnc\s+-[el]",
    r"\bcurl\s+.*\|\s*(bash|sh)", r"\bwget\s+.*\|\s*(bash|sh)", r"\bpasswd\b", r"\bshadow\b", r"\bkill\s+-9\s+1\b", r"\bshutdown\b", r"\breboot\b", r"\bhalt\b", r"\breg\s+(delete|add)\s+HKLM", r":\s*\(\s*\)\s*\{",
)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_GROUPED = r"(?<=(?<![\d.])\d{1,3}(?:,\d{3}){0,9}),(?=\d{3}(?:,\d{3})*(?:\.\d+)?(?![\d,]))"


def any_of(*tests: Column) -> Column:
    return reduce(or_, tests)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _json(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def lenient_json(text: Column) -> Column:
    """The JSON that a text holds, or null: the first fenced block, all from the first fence to the last, and of each
    (of the whole text, where nothing is fenced) the outermost object, then the outermost array."""
    body = strip(text)
    fenced = F.array(*[F.regexp_extract(body, rf"(?s)```(?:json)?\s*({inner})\s*```", 1) for inner in (".*?", ".*")])
    sources = F.when(body.rlike("(?s)```.*```"), fenced).otherwise(F.array(body))
    parts = F.flatten(F.transform(sources, lambda x: F.array(x, F.regexp_extract(x, r"(?s)\{.*\}", 0), F.regexp_extract(x, r"(?s)\[.*\]", 0))))
    tries = F.concat(F.when(body.rlike("(?s)```.*```"), fenced).otherwise(F.array().cast("array<string>")), parts)
    return F.get(F.filter(F.transform(tries, _json), lambda x: x.isNotNull()), F.lit(0))


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<think>.*?</think>", "")


def tagged(text: Column, tag: str) -> Column:
    """Contents of each closed tag outside thoughts, in order, trimmed."""
    return F.transform(F.regexp_extract_all(without_thoughts(text), F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), strip)


def tool_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of the JSON calls of a text; a call whose tag is cut off counts if its object is whole."""
    closed = tagged(text, "tool_call")
    cut = F.regexp_extract(without_thoughts(text), r"(?s)<tool_call>\s*(\{.*\})", 1)
    found = F.filter(F.transform(F.when(F.size(closed) > 0, closed).otherwise(F.array(cut)), _json), lambda x: x.isNotNull())
    of = lambda j, *keys: F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{k}"), F.lit("")) for k in keys])
    return F.filter(F.transform(found, lambda j: F.struct(of(j, "tool", "name").alias("name"), F.coalesce(of(j, "params", "arguments"), F.lit("{}")).alias("arguments"))), lambda c: c["name"].isNotNull())


def answer_of(text: Column) -> Column:
    """struct<answer, data_source>: of the first answer tag, else of the whole text as JSON, else of the first flat object with an answer, else the text."""
    tag, whole = F.get(tagged(text, "answer"), F.lit(0)), strip(text)
    flat = F.regexp_extract(whole, r'(?s)\{[^{}]*"answer"[^{}]*\}', 0)
    has = lambda x: F.get_json_object(_json(x), "$.answer").isNotNull()
    held = F.when(tag.isNotNull(), tag).when(has(whole), whole).when(has(flat), flat).otherwise(F.coalesce(whole, F.lit("")))
    parsed = _json(held)
    answer = F.coalesce(F.get_json_object(parsed, "$.answer"), held)
    sources = F.coalesce(F.from_json(F.get_json_object(parsed, "$.data_source"), "array<string>"), F.array().cast("array<string>"))
    return F.struct(answer.alias("answer"), sources.alias("data_source"))


def headed_answer(text: Column) -> Column:
    """What follows the first of the answer headings that a text holds; null if none."""
    tries = [F.when(F.contains(text, F.lit(h)), strip(F.substr(text, F.instr(text, h) + len(h)))) for h in ANSWER_HEADINGS]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries])


def answer_issues(answer: Column) -> Column:
    """What is wrong with struct<answer, data_source>; an empty array if nothing."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(strip(answer["answer"]), F.lit("")) == "", "answer is empty"),
            F.when(F.coalesce(F.size(answer["data_source"]), F.lit(0)) <= 0, "data_source is empty"),
            F.when(F.exists(answer["data_source"], lambda s: s.isNull()), "data_source has non-string entries"),
        )
    )


def format_issues(text: Column) -> Column:
    """Unpaired or missing action tags of a response, thoughts left out."""
    outside = without_thoughts(F.replace(F.replace(text, F.lit("<thinking>"), F.lit("<think>")), F.lit("</thinking>"), F.lit("</think>")))
    count = lambda tag: F.regexp_count(outside, F.lit(tag))
    unpaired = [F.when((count(f"<{t}>") > 0) & (count(f"<{t}>") != count(f"</{t}>")), f"{t} tags mismatch") for t in ("tool_call", "answer", "current_step")]
    return F.array_compact(F.array(F.when((count("<tool_call>") == 0) & (count("<answer>") == 0), "missing action tags"), *unpaired))


def is_refused(command: Column) -> Column:
    """Commands of the deny list, and deletions that end in a slash."""
    return command.rlike("(?i)" + "|".join(REFUSED)) | F.lower(command).rlike(r"(rm|del|rmdir)\s+.*[/\\]$")


def normal(text: Column) -> Column:
    """Half-width, without white space and common punctuation, in lower case: for fuzzy equality."""
    return F.lower(F.regexp_replace(full_to_half(text), r"""[\s，。！？、；：“”‘’（）—…《》.,!?;:"'()\-\[\]]+""", ""))


def normal_light(text: Column) -> Column:
    """Half-width, with single spaces."""
    return F.regexp_replace(full_to_half(strip(text)), r"\s+", " ")


def match_form(text: Column) -> Column:
    """Without commas and white space, in lower case: for containment."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s,，]+", ""))


def amount(text: Column) -> Column:
    """A number with magnitude and units as a double; null if it is none. A % sign is dropped."""
    bare = F.regexp_replace(text, "[,，% ]", "")
    plain = lambda x: F.regexp_replace(x, f"[{AMOUNT_UNITS}]+$", "")
    as_number = lambda x: F.when(x.rlike(_NUMBER), x.try_cast("double"))
    out = as_number(plain(bare))
    for suffix, factor in reversed(AMOUNT_SUFFIXES):
        out = F.when(F.endswith(bare, F.lit(suffix)), as_number(plain(F.substr(bare, F.lit(1), F.length(bare) - len(suffix)))) * factor).otherwise(out)
    return out


def amounts_in(text: Column) -> Column:
    """array<double>: the values of distinct number tokens of a text, in order."""
    raw = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMOUNT), F.lit(1)), lambda x: strip(F.replace(x, F.lit(","), F.lit("")))))
    return F.filter(F.transform(raw, amount), lambda v: v.isNotNull())


def numbers_and_percents(text: Column) -> Column:
    """struct<values, percents>: distinct signed numbers, and numbers before % or percentage points. Thousands separators are dropped."""
    plain = F.regexp_replace(text, _GROUPED, "")
    found = lambda pattern: F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))
    return F.struct(
        F.array_union(found(r"(?<!\d)(-?\d+\.\d+)(?!\d)"), found(r"(?<![\d.])(-?\d+)(?![\d.])")).alias("values"),
        F.array_union(found(r"(-?\d+\.?\d*)\s*%"), found(r"(-?\d+\.?\d*)\s*个百分点")).alias("percents"),
    )


def same_answer(a: Column, b: Column, strict: bool = True) -> Column:
    """Whether two struct<answer, data_source> agree. Leniently: equal texts but for spaces, or four fifths of the
    numbers of the one with fewer; without numbers one text in the other. Sources must be the same either way."""
    sources = F.sort_array(a["data_source"]) == F.sort_array(b["data_source"])
    if strict:
        return sources & (a["answer"] == b["answer"])
    x, y = (F.regexp_replace(strip(s["answer"]), r"\s+", " ") for s in (a, b))
    m, n = (F.array_union(v["values"], v["percents"]) for v in (numbers_and_percents(a["answer"]), numbers_and_percents(b["answer"])))
    few = F.least(F.size(m), F.size(n))
    within = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    return sources & ((x == y) | F.when((F.size(m) == 0) & (F.size(n) == 0), within).otherwise((few > 0) & (F.size(F.array_intersect(m, n)) >= 0.8 * few)))


def first_time(text: Column) -> Column:
    """The first time expression of a text; null if none."""
    return F.nullif(F.regexp_extract(text, TIME, 1), F.lit(""))


def group_key(rollout: Column) -> Column:
    """A rollout's id without its last rollout suffix."""
    return F.regexp_replace(rollout, r"_k\d+$", "")


def answer_object(text: Column) -> Column:
    """struct<object, issue>: an answer's JSON object, and what is wrong with how it was given; the object is null where there is none.

    JSON in a fenced block is taken with a warning; JSON that is no object is wrapped, with a warning.
    """
    body = strip(F.coalesce(text, F.lit("")))
    blocks = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)\n?```"), F.lit(1)), lambda b: _json(strip(b))), lambda j: j.isNotNull())
    direct, fenced = _json(body), F.get(blocks, F.lit(0))
    found = F.coalesce(direct, fenced)
    is_object = F.startswith(found, F.lit("{"))
    issue = (
        F.when(body == "", "empty").when(found.isNull(), "no JSON").when(found == "{}", "empty object").when(~is_object, "no object").when(direct.isNull(), "in a code block")
    )
    return F.struct(F.when(is_object & (found != "{}"), found).when(found.isNotNull() & ~is_object, F.concat(F.lit('{"_raw":'), found, F.lit("}"))).alias("object"), issue.alias("issue"))


def claims_of(answer: Column) -> Column:
    """array<struct<text, file>> of an answer's object (JSON text): its score points; else its answer, result, conclusion and claims; else itself."""
    text = lambda x, *names: F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{n}"), F.lit("")) for n in names])
    listed = lambda n: F.coalesce(F.from_json(F.get_json_object(answer, f"$.{n}"), "array<string>"), F.array().cast("array<string>"))
    claim = lambda t, f: F.struct(t.alias("text"), F.coalesce(f, F.lit("")).alias("file"))
    is_object = lambda x: F.startswith(strip(x), F.lit("{")) & F.try_parse_json(x).isNotNull()
    points = F.transform(listed("score_points"), lambda x: F.when(is_object(x), claim(F.coalesce(text(x, "scorepoint", "text", "content"), F.lit("")), text(x, "table", "data_source"))).otherwise(claim(x, F.lit(""))))

    def of(name: str) -> Column:
        held = F.get_json_object(answer, f"$.{name}")
        many = F.transform(listed(name), lambda x: F.when(is_object(x), claim(F.coalesce(text(x, "text", "value"), x), text(x, "table", "data_source"))).otherwise(claim(x, F.lit(""))))
        return F.when(held.isNull(), many).when(F.startswith(held, F.lit("[")), many).when(F.startswith(held, F.lit("{")), F.slice(many, 1, 0)).otherwise(F.array(claim(held, F.lit(""))))

    flat = F.concat(*[of(n) for n in ("answer", "result", "conclusion", "claims")])
    return F.when(F.size(points) > 0, points).when(F.size(flat) > 0, flat).otherwise(F.array(claim(answer, F.lit(""))))


def invalid_call(name: Column, arguments: Column, *registered: str) -> Column:
    """What makes a call invalid: no name, a name that no tool has, arguments that are no JSON object; null if nothing. Null arguments are none."""
    unknown = ~name.isin(*registered) if registered else F.lit(False)
    broken = arguments.isNotNull() & ~F.coalesce(F.startswith(strip(arguments), F.lit("{")) & F.try_parse_json(arguments).isNotNull(), F.lit(False))
    return F.when(F.coalesce(strip(name), F.lit("")) == "", "no name").when(unknown, "unknown tool").when(broken, "arguments are no object")
