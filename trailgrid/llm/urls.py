"""URL filter with redirect equivalence: verdicts of rules, then block decisions passed to aliases.

Addresses joined by a canonical link, a refresh or a given redirect form components; a page without
a rule of its own is blocked if a member of its component is blocked and none is explicitly allowed.
Links are resolved as browsers do: against the page's host for `/x`, its folder for `x` and `../x`, its
scheme for `//host/x`; `://` counts only after a leading scheme, not inside a query. An address is named by
128 bits of its host and path with query.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; an url without a
leading scheme and host has no aliases; repeated pages repeat their result; a link to the page itself, an
empty one, and one of another scheme without host (`mailto:`) give no edge; all links of a page count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

#: The rules that the contract names.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _rest(url) -> F.Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(F.col(url)), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(_rest(F.col(url)), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _address(rest) -> F.Column:
    """What names an address: host, and path with its query, of what follows `//`, without fragment and a last slash; null without a host."""
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    path, query = F.regexp_extract(tail, r"^[^?]*", 0), F.regexp_extract(tail, r"\?.*$", 0)
    steps = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x.isin(".", ""), done).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(host != "", F.md5(F.concat_ws("/", host, F.array_join(steps, "/"), query)))


def _tail(url) -> F.Column:
    """What follows a leading scheme and `//`; null without them."""
    return F.when(url.rlike(_SCHEME + "//"), F.regexp_replace(url, _SCHEME + "//", ""))


def alias_key(url: str) -> F.Column:
    return _address(_tail(F.col(url)))


def target_key(url: str, link: F.Column) -> F.Column:
    """The address that a link of a page leads to; null where it leads to no other."""
    base = _tail(F.col(url))
    host, path = F.regexp_extract(base, r"^[^/?#]*", 0), F.regexp_extract(base, r"^[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^.*/", 0), F.lit("")), F.lit("/"))
    rest = (
        F.when(link.rlike(_SCHEME + "//"), _tail(link)).when(F.startswith(link, F.lit("//")), F.substr(link, F.lit(3))).when(link.rlike(_SCHEME) | F.startswith(link, F.lit("#")), None)
        .when(F.startswith(link, F.lit("/")), F.concat(host, link)).when(F.startswith(link, F.lit("?")), F.concat(host, path, link)).otherwise(F.concat(host, folder, link))
    )
    return _address(rest)


def rule_of(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule and its verdict; of equally long ones the first by code point."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every page. redirects: optional (from_url, to_url)."""
    scratch = Scratch(pages.sparkSession, "urls")
    links = F.concat(*[F.coalesce(F.regexp_extract_all(F.col(html_col), F.lit(p), F.lit(1)), F.array().cast("array<string>")) for p in (_LINK, _REFRESH)])
    read = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), links.alias("links")).withColumns({"host": host_of("url"), "path": path_of("url")})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    leads = F.array_distinct(F.array_compact(F.transform("links", lambda x: target_key("url", x))))
    read = read.select("key", "host", "path", rule.alias("rule"), verdict.alias("said"), alias_key("url").alias("node"), leads.alias("leads"))
    rows = scratch.keep(read, "rows")
    edges = rows.where("node is not null").select("node", F.explode("leads").alias("to"))
    if redirects is not None:
        edges = edges.unionAll(redirects.select(alias_key("from_url"), target_key("from_url", F.col("to_url"))))
    roots = components(edges, "node", "to", scratch)
    # Blocked or allowed addresses, once each, with their component; the address itself where it has no link.
    told = rows.where("said is not null and node is not null").groupBy("node").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    told = told.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    blocked = told.where("blocked and not allowed").select("root", F.lit(True).alias("hit"))
    aliases = blocked.join(roots, "root", "left").select(F.coalesce("node", "root").alias("at"), "hit").distinct()
    # Pages without an address meet nothing; they are dealt by a number, not all by one null.
    at = F.coalesce("node", F.concat(F.lit("-"), F.pmod(F.xxhash64("key", "host", "path"), F.lit(4096)).cast("string")))
    return rows.withColumn("at", at).join(aliases, "at", "left").select(
        F.col("key").alias(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict")
    )
