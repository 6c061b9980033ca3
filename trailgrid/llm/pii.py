"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds email, ip, card and phone are found leftmost and without overlap within a kind; what a check
rejects is dropped and not tried again. Kinds iban (mod 97), ssn (area, group and serial in range)
and secret (keys of letters and digits, of any length from 20 on) start below the threshold or above
it by their check, and whole words within NEAR code points before or after move them: `key` counts in
`api_key=`, not in `monkey`. Every pattern is linear in the text: runs are possessive and starts are
fixed by what stands before them.

Defined cases: a null text is empty and has no spans; offsets count code points, end exclusive;
spans of different kinds may overlap; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: Kinds in the order of results.
BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
KINDS = BASE + MORE
#: Spans scoring less are dropped; base kinds start above whatever words can take away.
THRESHOLD = 0.5
NEAR = 40
#: Score of a confirmed pattern, gain with a context word, loss with a word that speaks against it.
START = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.35, "secret": 0.3}
GAIN, LOSS = 0.3, 0.2
CONTEXT = {
    "email": ("mail", "email", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telephone", "tél"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "api", "auth", "bearer"),
}
#: How keys of some services begin; such a key needs no context.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_")
AGAINST = ("example", "sample", "version", "isbn", "order no", "sha256", "md5", "commit")

_AT = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+])[A-Za-z0-9_]{20,}+(?![/+=])")
_WORDS = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part, not before the last match: the leftmost match without its quadratic search."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            yield start, (end := m.end())
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    found["email"] = list(emails(text))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        while len(plain) >= 15 and not mod97(plain):  # a following word in capitals may have been taken in
            cut = m[0][: len(m[0]) - 1] if " " not in m[0] else m[0].rpartition(" ")[0]
            if cut == m[0] or " " not in m[0]:
                plain = ""
                break
            m = _IBAN.match(text, m.start(), m.start() + len(cut)) or m
            if len(m[0]) > len(cut):
                plain = ""
                break
            plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()
    for m in _SECRET.finditer(text):
        if sum(c.isdigit() for c in m[0]) * 8 >= len(m[0]) and sum(c.isalpha() for c in m[0]) * 8 >= len(m[0]):
            yield "secret", *m.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    near = " ".join(["", *_WORDS.findall(text[max(0, start - NEAR) : start].lower()), "|", *_WORDS.findall(text[end : end + NEAR].lower()), ""])
    says = lambda words: any(f" {w} " in near for w in words)
    value = START[kind] + GAIN * says(CONTEXT[kind])
    if kind == "secret":
        value += GAIN * text.startswith(PREFIXES, start)
    if kind in MORE:
        value -= LOSS * says(AGAINST)
    return round(min(1.0, value), 6)


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    if not text:
        return []
    out = [(k, a, b, score(k, text, a, b)) for k, found in base_spans(text).items() for a, b in found]
    more = [(k, a, b, score(k, text, a, b)) for k, a, b in more_spans(text)]
    return out + sorted((x for x in more if x[3] >= THRESHOLD), key=lambda x: (KINDS.index(x[0]), x[1]))


def masked(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pii array<struct<kind, start, end, score>>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["key", "pii"])

    rows = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("txt"))
    return rows.mapInArrow(tidy(run), T.StructType([T.StructField("key", documents.schema[id_col].dataType), T.StructField("pii", _SPANS)])).withColumnRenamed("key", id_col)


def mask(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with personal data in text_col replaced by placeholders; null texts stay null."""
    place, names = documents.columns.index(text_col), documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = [t and masked(t, spans(t)) for t in (x.as_py() for x in batch.column(place))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], names=names)

    return documents.mapInArrow(tidy(run), documents.schema)


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the count of each base kind, base_sha256, spans as text and the score of each span."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    found = find(documents)
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("pii", lambda x: x["kind"] == k)
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", shown), ",").alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
