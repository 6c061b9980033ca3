"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of 0 to ORDER bytes, from a bounded sample of labelled
rows, then frozen. The code length of a byte is exact: from the longest known context it pays an
escape (method C: distinct symbols over total plus distinct) for each context that lacks the byte,
with the symbols of longer contexts excluded, and ends in a uniform code. Under frozen statistics a
code length depends on ORDER + 1 bytes, so a text is its counts of such grams, each scored once per worker.

A text is `known` if its best language codes it about as short as texts that it has not seen: a
ceiling is MARGIN times the QUANTILE of bits a byte that each fifth of the language's sample takes
under a tree of the other four; SLACK bits are forgiven, so that a few keys or numbers reject no text.

Defined cases: a null text, a text without a letter, and a corpus without labelled rows give `und`
with score 0 and are not known; equal code lengths go to the language that sorts first; rows with null
lang or null doc_id are not learned from, equal rows once; a language of fewer than CALIBRATED sampled
rows has no ceiling; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy, unit

#: Longest context in bytes.
ORDER = 3
#: The sample that is learned from: rows for each language (fewer from 20 languages on), characters of each row.
SAMPLE_ROWS, SAMPLE_ALL, SAMPLE_CHARS = 240, 4800, 4000
#: A ceiling: rows of a language that it needs, quantile of unseen rows, factor over it, bits that are forgiven.
CALIBRATED, QUANTILE, MARGIN, SLACK = 20, 0.9, 3.0, 96
#: Grams that a worker remembers; beyond that its memory starts anew.
REMEMBERED = 1_000_000
_LETTER = re.compile(r"[^\W\d_]")


def is_held_out(doc_id="doc_id") -> F.Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(text: str) -> np.ndarray:
    """Each byte of the lower-cased text, and of the space after it, with the ORDER bytes before it, as one number."""
    raw = np.frombuffer(b" " * ORDER + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.uint32)
    n = len(raw) - ORDER
    out = raw[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= raw[ORDER - k : ORDER - k + n] << np.uint32(8 * k)
    return out


class ContextTree:
    """Frozen counts of one language: context bytes to symbol counts, from counts of its grams."""

    def __init__(self, counts: Counter):
        nodes: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for gram, n in counts.items():
            raw = gram.to_bytes(ORDER + 1, "big")
            for k in range(ORDER + 1):
                nodes[raw[k:-1]][raw[-1]] += n
        self.nodes = {c: dict(s) for c, s in nodes.items()}

    def symbol_bits(self, gram: bytes) -> float:
        """Code length of gram's last byte after the bytes before it."""
        context, symbol, bits, excluded = gram[:-1], gram[-1], 0.0, set()
        while True:
            node = self.nodes.get(context)
            if node:
                left = {s: n for s, n in node.items() if s not in excluded} if excluded else node
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return bits - math.log2(left[symbol] / total)
                if left:
                    bits -= math.log2(len(left) / total)
                    excluded.update(left)
            if not context:
                return bits + math.log2(256 - len(excluded))
            context = context[1:]


class LanguageModel:
    def __init__(self, samples: dict[str, Counter], ceilings: dict[str, float] | None = None):
        self.samples = samples
        self.ceilings = ceilings or {}
        self.langs = sorted(samples)
        self.trees = [ContextTree(samples[x]) for x in self.langs]
        self.place: dict[int, int] = {}
        self.bits = np.zeros((1024, len(self.langs)))

    def rows_of(self, kinds: list[int]) -> list[int]:
        """Rows of self.bits, where new grams are added."""
        place = self.place
        try:
            return [place[g] for g in kinds]
        except KeyError:
            pass
        if len(place) + len(kinds) > REMEMBERED:
            place.clear()
        for g in kinds:
            if g not in place:
                at = place[g] = len(place)
                if at == len(self.bits):
                    self.bits = np.vstack([self.bits, np.zeros_like(self.bits)])
                raw = g.to_bytes(ORDER + 1, "big")
                self.bits[at] = [t.symbol_bits(raw) for t in self.trees]
        return [place[g] for g in kinds]

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text under each language, in the order of langs."""
        total = np.zeros(len(self.langs))
        kinds, counts = np.unique(grams(text), return_counts=True)
        for at in range(0, len(kinds), 100_000):
            total += counts[at : at + 100_000] @ self.bits_of(kinds[at : at + 100_000].tolist())
        return total

    def bits_of(self, kinds: list[int]) -> np.ndarray:
        rows = self.rows_of(kinds)
        return self.bits[rows]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, its share of the probability under equal priors, bits a byte, and whether these are below its ceiling."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0, False
        bits, size = self.code_lengths(text), len(text.encode("utf-8", "surrogatepass"))
        best = int(bits.argmin())
        lang, share = self.langs[best], 1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum()
        return lang, float(share), float(bits[best] / size), bool(bits[best] - SLACK <= self.ceilings.get(lang, math.inf) * size)


def _counted(texts: list[np.ndarray]) -> Counter:
    kinds, counts = np.unique(np.concatenate(texts), return_counts=True)
    return Counter(dict(zip(kinds.tolist(), counts.tolist(), strict=True)))


def fit(sample: dict[str, list[str]]) -> LanguageModel:
    """A model of texts by language: trees of all of them, ceilings from each fifth under the other four."""
    seen = {lang: [grams(t) for t in texts] for lang, texts in sample.items()}
    ceilings = {}
    for lang, texts in seen.items():
        if len(texts) >= CALIBRATED:
            rates = []
            for k in range(5):
                tree, bits = ContextTree(_counted([t for i, t in enumerate(texts) if i % 5 != k])), {}
                for t in texts[k::5]:
                    kinds, counts = np.unique(t, return_counts=True)
                    for g in kinds.tolist():
                        if g not in bits:
                            bits[g] = tree.symbol_bits(g.to_bytes(ORDER + 1, "big"))
                    rates.append(sum(bits[g] * n for g, n in zip(kinds.tolist(), counts.tolist())) / len(t))
            ceilings[lang] = MARGIN * float(np.quantile(rates, QUANTILE))
    return LanguageModel({lang: _counted(texts) for lang, texts in seen.items()}, ceilings)


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from at most SAMPLE_ROWS rows a language, the first by a hash of id and text among rows that aren't held out.

    Rows of one id and text count once, so neither a hot id nor a hot text brings more rows to the driver.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("txt"), F.col(lang_col).cast("string").alias("lang")).where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("txt").isNotNull())
    order = F.xxhash64(F.col("doc_id").cast("string"), "txt", F.lit("language sample"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(order, 0.05).alias("n")).collect()}  # one row a language
    if not counts:
        return LanguageModel({})
    each = max(1, min(SAMPLE_ROWS, SAMPLE_ALL // len(counts)))
    # Somewhat more than is kept is drawn, so that the first `each` by hash are surely among them.
    rate = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (1.5 * each + 60) / max(n, 1))))])[F.col("lang")]
    drawn = rows.withColumn("o", order).where(unit("o") < rate).select("lang", "o", F.substring("txt", 1, SAMPLE_CHARS).alias("txt")).dropDuplicates(["lang", "o"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("o", "txt"))
    sample: dict[str, list[str]] = defaultdict(list)
    for r in drawn.withColumn("rn", first).where(F.col("rn") <= each).orderBy("lang", "rn").toLocalIterator():
        sample[r["lang"]].append(r["txt"])
    return fit(sample)


def _identified(documents: DataFrame, model: LanguageModel, text_col: str, carried: list[str]) -> DataFrame:
    """c0, c1, ... (the carried columns) with lang_pred, score, bits_a_byte and known."""
    shared = documents.sparkSession.sparkContext.broadcast((model.samples, model.ceilings))
    names = [*[f"c{i}" for i in range(len(carried))], "lang_pred", "score", "bits_a_byte", "known"]
    place = carried.index(text_col) if text_col in carried else len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            found = [own.predict(x.as_py()) for x in batch.column(place)]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *made], names=names)

    fields = [T.StructField(n, documents.schema[c].dataType) for n, c in zip(names, carried)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_a_byte", T.DoubleType()), T.StructField("known", T.BooleanType())])
    given = [F.col(c).alias(n) for n, c in zip(names, carried)] + [F.col(text_col).alias("txt")] * (place == len(carried))
    return documents.select(*given).mapInArrow(tidy(run), schema)


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, bits_a_byte, known) of every whole text."""
    return _identified(documents, model, text_col, [id_col]).withColumnRenamed("c0", id_col)


def keep_known(documents: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """documents without those that no learned language codes well: `und` (null texts are), and code lengths above the ceiling.

    A model that has learned no language rejects nothing. Columns may have any names.
    """
    if not model.langs:
        return documents
    found = _identified(documents, model, text_col, documents.columns).where("known")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])


def predictions(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, bits_a_byte, known."""
    return identify(documents, learn(documents)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "bits_a_byte", "known")
