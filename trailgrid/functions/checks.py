"""Checks and rewrites of what agents write: numbers against observations, call signatures, client-side call layouts, paths and observations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import any_of, numbers_and_percents, strip
from .claims import signed_percents

#: Statements of a base year, which claim no value.
BASE_YEAR = (r"(上年|基期|基准年|基年)\s*[=＝]\s*\d+", r"以\s*\d+\s*(年|年为止)?\s*(为|作为)\s*(基期|基准)", r"(上年|同比)\s*[=＝]\s*100")
#: Guesses at causes.
SPECULATION = (r"可能与.*(?:有关|影响|导致|引起|所致)", r"可能(?:预示着|意味着|反映出|暗示着|代表着)", r"(?:表明|说明|这表明|这说明).*(?:导致|引起|造成)")
#: Argument names that hold paths, ranges and search terms, tags of thoughts, what stands for the folder of files.
PATH_KEYS = ("file_path", "path", "filename", "file", "table_path", "csv_path")
RANGE_KEYS = ("range", "region", "cell_range", "sheet_range")
SEARCH_KEYS = ("query", "keyword", "search", "keywords", "search_term")
CONFINED_KEYS = ("folder_path", "file_path", "path", "table_path", "directory")
THOUGHTS = ("think", "reasoning", "thought")
ROOT = "<TABLE_ROOT>"


def _calls(pairs) -> Column:
    return F.struct(pairs[0].alias("name"), pairs[1].alias("arguments"))


def unseen_numbers(answer: Column, observations: Column) -> Column:
    """array<double>: the numbers of an answer that no observation (array<string>) shows.

    Percentages count with the sign that their words give, on both sides; a difference in percentage points may also be
    one of two observed values (within 0.02). Base-year statements claim nothing.
    """
    text = F.coalesce(answer, F.lit(""))
    for pattern in BASE_YEAR:
        text = F.regexp_replace(text, pattern, "")
    bare = F.transform(observations, lambda o: F.regexp_replace(F.regexp_replace(F.coalesce(o, F.lit("")), r"-?\d+\.?\d*\s*%", ""), r"-?\d+\.?\d*\s*个百分点", ""))
    seen = F.array_distinct(F.concat(F.flatten(F.transform(observations, lambda o: F.transform(signed_percents(F.coalesce(o, F.lit(""))), lambda c: c["value"]))), F.flatten(F.transform(bare, lambda o: numbers_and_percents(o)["values"]))))
    differs = lambda v: F.exists(seen, lambda a: F.exists(seen, lambda b: (a < b) & (F.abs((b - a) - F.abs(v)) < 0.02)))
    claims = F.filter(signed_percents(text), lambda c: ~F.array_contains(seen, c["value"]) & ~((c["unit"] == "percentage_point") & (F.abs(c["value"]) < 100) & differs(c["value"])))
    plain = F.filter(numbers_and_percents(text)["values"], lambda v: ~F.array_contains(seen, v))
    return F.concat(F.transform(claims, lambda c: c["value"]), plain)


def speculative(entries: Column) -> Column:
    """Numbers (from 0) of the entries (array<string>) that guess at a cause."""
    told = F.transform(entries, lambda e, i: F.when(any_of(*[e.rlike(p) for p in SPECULATION]), i))
    return F.filter(told, lambda i: i.isNotNull())


def canonical_arguments(arguments: Column) -> Column:
    """The arguments of a call (JSON object text) in one form: keys in order, base names of paths, ranges in capitals, search terms sorted, doubles at six places.

    Text that is no object is kept, trimmed.
    """
    given = F.from_json(arguments, "map<string,string>")

    def value(k: Column, v: Column) -> Column:
        key = F.lower(k)
        terms = F.array_sort(F.filter(F.split(v, r"[,\s]+"), lambda t: t != ""))
        base = F.regexp_extract(F.replace(v, F.lit("\\"), F.lit("/")), r"[^/]*$", 0)
        number = F.when(v.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), F.round(v.try_cast("double"), 6).cast("string"))
        return F.when(key.isin(*PATH_KEYS), base).when(key.isin(*RANGE_KEYS), F.upper(strip(v))).when(key.isin(*SEARCH_KEYS), F.array_join(terms, " ")).otherwise(F.coalesce(number, strip(v)))

    entries = F.array_sort(F.transform(F.map_entries(given), lambda e: F.struct(e["key"].alias("key"), value(e["key"], e["value"]).alias("value"))))
    return F.when(given.isNull(), strip(F.coalesce(arguments, F.lit("")))).otherwise(F.to_json(F.map_from_entries(entries)))


def call_signature(name: Column, arguments: Column) -> Column:
    """What makes two calls the same."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit("::"), canonical_arguments(arguments))


def thoughts(text: Column) -> Column:
    """struct<reasoning, rest>: what stands in tags of thoughts, by tag and in order, and the text without them."""
    parts, rest = [], F.coalesce(text, F.lit(""))
    for tag in THOUGHTS:
        pattern = f"(?is)<{tag}>(.*?)</{tag}>"
        found = F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))
        parts.append(F.transform(found, strip))
        rest = F.when(F.size(found) > 0, strip(F.regexp_replace(rest, pattern, ""))).otherwise(rest)
    told = F.concat(*parts)
    return F.struct(F.when(F.size(told) > 0, F.array_join(told, "\n\n")).alias("reasoning"), rest.alias("rest"))


def client_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of JSON in call tags, then of invoke tags; where there are neither, of fenced JSON objects. Arguments are JSON texts."""
    said = F.coalesce(text, F.lit(""))
    first = lambda j, *names: F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{n}"), F.lit("")) for n in names])

    def of_json(bodies: Column) -> Column:
        whole = F.transform(bodies, lambda b: F.coalesce(F.when(F.try_parse_json(strip(b)).isNotNull(), strip(b)), F.regexp_extract(b, r"(?s)^\s*(\{.*\})", 1)))
        made = F.transform(F.filter(whole, lambda j: F.startswith(j, F.lit("{")) & F.try_parse_json(j).isNotNull()), lambda j: F.struct(first(j, "tool", "name", "function").alias("name"), F.coalesce(F.nullif(F.nullif(first(j, "params", "arguments", "parameters"), F.lit("[]")), F.lit("{}")), F.lit("{}")).alias("arguments")))
        return F.filter(made, lambda c: c["name"].isNotNull())

    tags = of_json(F.regexp_extract_all(said, F.lit("(?is)<tool_call>(.*?)</tool_call>"), F.lit(1)))
    invoked = F.regexp_extract_all(said, F.lit(r"""(?is)<invoke\s+name=["'].*?["']\s*>.*?</invoke>"""), F.lit(0))
    parameter = r"""(?is)<parameter\s+name=["'](.*?)["']\s*>(.*?)</parameter>"""
    pairs = lambda x: F.arrays_zip(F.regexp_extract_all(x, F.lit(parameter), F.lit(1)).alias("k"), F.transform(F.regexp_extract_all(x, F.lit(parameter), F.lit(2)), strip).alias("v"))
    last = lambda x: F.aggregate(pairs(x), F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    xml = F.transform(invoked, lambda x: F.struct(F.regexp_extract(x, r"""(?is)<invoke\s+name=["'](.*?)["']""", 1).alias("name"), F.to_json(last(x)).alias("arguments")))
    both = F.concat(tags, xml)
    fenced = of_json(F.regexp_extract_all(said, F.lit(r"(?is)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1)))
    return F.when(F.size(both) > 0, both).otherwise(fenced)


def is_structured(messages: Column) -> Column:
    """Whether an array of messages (role, calls) is of the structured kind: an assistant's calls, or a tool's row."""
    return F.exists(messages, lambda m: (m["role"] == "tool") | ((m["role"] == "assistant") & (F.coalesce(F.size(m["calls"]), F.lit(0)) > 0)))


def step_plan(reasoning: Column, work: str = r"/tmp/data/task_\w+") -> Column:
    """A plan without the folders of one run: its folder of files, then any other, become a mark; notes of the folder go."""
    text = F.regexp_replace(strip(F.coalesce(reasoning, F.lit(""))), work + "/dataset/tables", ROOT)
    return F.regexp_replace(F.regexp_replace(text, work + "/", ROOT + "/"), "当前的工作环境路径是：[^。]*。?", "")


def rooted(text: Column, *roots: str) -> Column:
    """Paths below the given folders (patterns), and the folders themselves, with a mark for the folder."""
    for root in roots:
        text = F.regexp_replace(F.regexp_replace(text, root + "/", ROOT + "/"), root + r"""(?=["'}\s，。；、！？)\]　]|$)""", ROOT + "/")
    return text


def absolute_paths(text: Column, *places: str) -> Column:
    """Absolute paths (below the given patterns) that are left in a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?<!{re.escape(ROOT)})/(?:{'|'.join(places)})/\\S+"), F.lit(0))


def resolved(argument: Column, root: str) -> Column:
    """An argument with the folder for its mark; the older form of the mark, which names the folder again, is mended."""
    bare = root.rstrip("/")
    whole = F.replace(argument, F.lit(ROOT), F.lit(bare))
    return F.regexp_replace(whole, f"^(.*?){re.escape(bare)}/dataset/tables/", f"$1{bare}/")


def normal_path(path: Column) -> Column:
    """A path without `.`, empty steps, and `..` with the step before it; one that starts with a slash stays absolute."""
    absolute = F.startswith(path, F.lit("/"))
    back = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    steps = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x.isin("", "."), done).when(x != "..", F.concat(done, F.array(x)))
        .when(F.try_element_at(done, F.lit(-1)).isNotNull() & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(absolute, done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(steps, "/"))


def confined(path: Column, root: str) -> Column:
    """A path within a folder: one outside is put below it, or, where that leads out again, becomes the folder."""
    inside = lambda p: (p == root) | F.startswith(p, F.lit(root + "/"))
    below = normal_path(F.concat(F.lit(root + "/"), F.regexp_replace(path, "^/+", "")))
    return F.when(F.coalesce(strip(path), F.lit("")) == "", path).when(inside(normal_path(path)), path).when(inside(below), below).otherwise(root)


def observation(success: Column, data: Column, message: Column, most: int = 4000) -> Column:
    """A tool's result as an agent reads it: marked, and cut to its last `most` characters with a note of how long it was."""
    text = F.when(success, F.concat(F.lit("[SUCCESS] "), F.coalesce(data, F.lit("")))).otherwise(F.concat(F.lit("[ERROR] "), F.coalesce(message, F.lit(""))))
    return F.when(F.length(text) > most, F.concat(F.lit("[Truncated, original length "), F.length(text).cast("string"), F.lit("]\n"), F.right(text, F.lit(most)))).otherwise(text)


def source_file(arguments: Column, content: Column) -> Column:
    """The file that a call reads: of its arguments (JSON text) by name, else the first file name of its result; null if none."""
    named = F.coalesce(*[F.get_json_object(arguments, f"$.{k}") for k in ("file_path", "path", "table", "table_name", "filename", "file")])
    return F.coalesce(named, F.nullif(F.regexp_extract(F.coalesce(content, F.lit("")), r"(\S+\.(?:xlsx|csv|xls))", 1), F.lit("")))


def history_text(messages: Column, most: int = 6, length: int = 200, style: str = "text", header: bool = True) -> Column:
    """The last messages (array<struct<role, content, calls array<struct<name, arguments>>>>) as text, each cut; styles text, markdown and xml."""
    labels = F.create_map(*[F.lit(x) for x in ("user", "User", "assistant", "Assistant", "system", "System", "tool", "Tool")])
    last = F.slice(messages, F.greatest(F.size(messages) - most + 1, F.lit(1)), most) if most else messages
    called = lambda m: F.array_join(F.transform(F.coalesce(m["calls"], F.array().cast("array<struct<name:string,arguments:string>>")), lambda c: F.concat(F.lit("Call tool: "), F.coalesce(c["name"], F.lit("unknown")), F.lit("("), F.coalesce(c["arguments"], F.lit("{}")), F.lit(")"))), "\n")
    body = lambda m: F.when((m["role"] == "assistant") & (called(m) != ""), F.concat_ws("\n", F.nullif(F.coalesce(m["content"], F.lit("")), F.lit("")), called(m))).otherwise(F.coalesce(m["content"], F.lit("")))
    cut = (lambda m: F.left(body(m), F.lit(length))) if length else body
    label = lambda m: F.coalesce(F.try_element_at(labels, F.coalesce(m["role"], F.lit("unknown"))), m["role"], F.lit("unknown"))
    lines = {
        "text": lambda m: F.concat(label(m), F.lit(": "), cut(m)), "markdown": lambda m: F.concat(F.lit("**"), label(m), F.lit("**: "), cut(m), F.lit("\n")),
        "xml": lambda m: F.concat(F.lit('  <message role="'), F.coalesce(m["role"], F.lit("unknown")), F.lit('">'), cut(m), F.lit("</message>")),
    }[style]
    before, after = {"text": (["Conversation History:"], []), "markdown": (["### Conversation History\n"], []), "xml": (["<conversation_history>"], ["</conversation_history>"])}[style] if header else ([], [])
    parts = F.concat(F.array(*map(F.lit, before)).cast("array<string>"), F.transform(last, lines), F.array(*map(F.lit, after)).cast("array<string>"))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, "").otherwise(F.array_join(parts, "\n"))


def steps_text(steps: Column, most: int = 800) -> Column:
    """Steps (array<struct<type, plan, calls, observations array<struct<content>>, answer>>) as text for a model, observations cut."""
    none = lambda kind: F.array().cast(kind)

    def told(s: Column) -> Column:
        calls = F.transform(F.coalesce(s["calls"], none("array<struct<name:string,arguments:string>>")), lambda c: F.concat(F.lit("[工具调用] "), F.coalesce(c["name"], F.lit("unknown")), F.lit("("), F.coalesce(c["arguments"], F.lit("{}")), F.lit(")")))
        seen = F.transform(F.transform(s["observations"], lambda o: o["content"]), lambda c: F.concat(F.lit("[工具返回] "), F.left(F.coalesce(c, F.lit("")), F.lit(most))))
        plan = F.when(F.coalesce(s["plan"], F.lit("")) != "", F.array(F.concat(F.lit("[规划] "), s["plan"]))).otherwise(none("array<string>"))
        answer = F.array(F.concat(F.lit("[最终答案] "), F.coalesce(s["answer"], F.lit("{}"))))
        return F.when(s["type"] == "tool_call", F.concat(plan, calls, F.coalesce(seen, none("array<string>")))).when(s["type"] == "final_answer", answer).otherwise(none("array<string>"))

    return F.array_join(F.flatten(F.transform(steps, told)), "\n")


def step_issues(steps: Column) -> Column:
    """What is wrong with the structure of steps (array<struct<type, calls array<struct<name>>>>)."""
    def of(s: Column, i: Column) -> Column:
        at = lambda text: F.concat(F.lit("step["), i.cast("string"), F.lit("]: " + text))
        unnamed = F.exists(s["calls"], lambda c: c["name"].isNull())
        return F.array_compact(F.array(F.when(~F.coalesce(s["type"].isin("tool_call", "final_answer"), F.lit(False)), at("unknown type")), F.when((s["type"] == "tool_call") & s["calls"].isNull(), at("no list of calls")), F.when((s["type"] == "tool_call") & F.coalesce(unnamed, F.lit(False)), at("a call without a name"))))

    return F.flatten(F.transform(steps, of))


def padded(values: Column, length: int, fill) -> Column:
    """An array filled up or cut to a length, for batches of one shape."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), length)), 1, length)
