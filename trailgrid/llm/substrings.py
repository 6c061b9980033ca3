"""Substring dedup by recompression.

Names are given by one hash for the whole corpus: first to runs of a word, then level by level to pairs
of neighbouring symbols whose sides, a bit of their hash, are left and right. A name depends on nearby
words only, and with each symbol goes the interval of words that fixed it, so a symbol within a window
stands in every copy of that window. Two Spark rounds tell over all texts which names are shared:

1. level ROUNDS of all texts. A window that holds a name no other text has cannot repeat.
2. level ROUNDS + MORE, where names are paired on only between neighbours that are shared (all others are
   separators now): again a window that holds an unshared name goes.

What is left is verified: windows are equal if a 64-bit number of their words and a 32-bit sum of the
shared names inside them are. The least document of each decides what is removed.

Exact copies are settled by their texts; only the least document of a text goes through the rounds.
Windows with no symbol of their own (long runs) are always numbered, so the rounds lose nothing.

Defined cases: a null text has no words; a null id precedes and follows nothing, so nothing of its
row is removed and it removes nothing; repeated rows with one id don't remove each other's words;
texts shorter than a window are kept whole; ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot, mix, tidy
from .tokens import batch_numbers, sequence_numbers, split_words, with_separators

#: Words of a window; levels of the first round and of the second above it.
WINDOW, ROUNDS, MORE = 50, 7, 3
_A, _B, _C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def runs(s: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, ...]:
    """Level 0: each maximal run of one word becomes a symbol, fixed by its words and the two beside it. bar: 1 at separators."""
    start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (bar[1:] > 0) | (bar[:-1] > 0)]))
    end = np.append(start[1:], len(s))
    length = end - start
    named = np.where(length > 1, mix(s[start] * _A + length.astype(np.uint64)), s[start])
    return named, start - 1, end + 1, bar[start]


def pairs(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, bar: np.ndarray, r: int) -> tuple[np.ndarray, ...]:
    """One level of naming left-right pairs, with the intervals of words that fixed each symbol; symbols with a bar stay alone."""
    right, barred = (mix(s + mix(np.array([r], np.uint64) * _C)) & np.uint64(1)).astype(bool), bar > 0
    right[0], right[-1] = False, True  # separators, which are in no pair
    head = np.zeros(len(s), bool)
    head[:-1] = ~(right[:-1] | barred[:-1] | barred[1:]) & right[1:]
    tail = np.zeros(len(s), bool)
    tail[1:] = head[:-1]
    out, new_lo, new_hi = s.copy(), lo.copy(), hi.copy()
    i = np.flatnonzero(~right[:-1])  # a left symbol is fixed by what follows, a right one that stays alone by what precedes
    new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
    i = np.flatnonzero((right & ~tail)[1:]) + 1
    new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i - 1]), np.maximum(hi[i], hi[i - 1])
    i = np.flatnonzero(head)
    out[i] = mix(s[i] * _A + s[i + 1] * _B + np.uint64(r))
    keep = ~tail
    return out[keep], new_lo[keep], new_hi[keep], bar[keep]


class Levels:
    """Symbols of a batch of texts at a level: names s, places [lo, hi) that fixed them, bars (1 between texts, 2 where a name is not shared).

    What reached a separator has its place in [lo, hi), so that no window of a text holds it; nor does any
    repeated window hold a symbol that reached an unshared one.
    """

    def __init__(self, texts: list[str | None], rounds: int):
        numbers, self.counts = batch_numbers(texts)
        self.words, bar, self.first = with_separators(numbers, self.counts)
        self.s, self.lo, self.hi, self.bar = runs(self.words, bar.astype(np.int8))
        self.level = 0
        self.rise(rounds)

    def rise(self, rounds: int) -> None:
        for _ in range(rounds):
            self.level += 1
            self.s, self.lo, self.hi, self.bar = pairs(self.s, self.lo, self.hi, self.bar, self.level)

    def live(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of symbols without a bar, and the text of each."""
        at = np.flatnonzero(self.bar == 0)
        return at, (np.cumsum(self.bar == 1) - 1)[at]

    def lists(self, keep: np.ndarray | None = None) -> pa.ListArray:
        """Names of the symbols without a bar, a list a text (of the texts to keep)."""
        at, text = self.live()
        if keep is not None:
            at = at[keep[text]]
            text = text[keep[text]]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.counts)))]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, self.s[at].view(np.int64))

    def bar_unshared(self, shared: pa.ListArray) -> np.ndarray:
        """Puts bars on all symbols but those at the given numbers among their text's; returns the places of the new bars."""
        at, text = self.live()
        base = np.searchsorted(text, np.arange(len(self.counts)))
        lengths = np.diff(shared.offsets.to_numpy())
        known = np.zeros(len(at), bool)
        known[shared.flatten().to_numpy(zero_copy_only=False) + np.repeat(base, lengths)] = True
        self.bar[at[~known]] = 2
        return at[~known]

    def check(self, starts: np.ndarray, window: int) -> np.ndarray:
        """32 bits of the sum of the names that the window at each start holds."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.s))])
        a, b = np.searchsorted(self.lo, starts), np.searchsorted(self.hi, starts + window, "right")
        return np.where(b > a, mix(total[np.maximum(a, b)] - total[a]), 0).astype(np.uint64).astype(np.uint32).view(np.int32)


def uncovered(lo: np.ndarray, hi: np.ndarray, places: int, window: int) -> np.ndarray:
    """Whether the window at each place holds none of the intervals."""
    a, b = np.maximum(hi - window, 0), np.minimum(lo + 1, places)
    fits = a < b
    change = np.bincount(a[fits], minlength=places + 1) - np.bincount(b[fits], minlength=places + 1)
    return np.cumsum(change[:-1]) == 0


def starts_of(first: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a whole window of a text starts, and the text of each."""
    n = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[text], text


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def dedup(documents: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, removed array<struct<from, to>>): word ranges to remove, in order, without overlap."""
    scratch = Scratch(documents.sparkSession, "substrings")
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    rows = rows.select("id", F.xxhash64("txt").alias("th"), (F.octet_length("txt").cast("long") * F.lit(1 << 32) + F.crc32(F.col("txt").cast("binary"))).alias("tl"), "txt")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(3).to_pylist()
                level = Levels(texts, rounds)
                place, owner = starts_of(level.first, level.counts, window)
                live, _ = level.live()
                blind = np.bincount(owner, weights=uncovered(level.lo[live], level.hi[live], len(level.words), window)[place], minlength=len(texts)) > 0
                sha = pa.array([_digest(split_words(t)) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(level.counts, pa.int64()), sha, level.lists(level.counts >= window), pa.array(blind)], names=["id", "th", "tl", "n_words", "sha", "symbols", "blind"])

    parsed = scratch.keep(rows.mapInArrow(tidy(parse), "id long, th long, tl long, n_words long, sha string, symbols array<long>, blind boolean"), "parsed")
    firsts = parsed.groupBy("th", "tl").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    known = scratch.keep(join_hot(parsed.select("id", "th", "tl", "n_words", "sha"), firsts, ["th", "tl"], parsed.count()), "known")
    once = parsed.where("n_words >= " + str(window)).select("id", "th", "tl", "symbols", "blind").join(firsts.select(F.col("first").alias("id"), "th", "tl"), ["id", "th", "tl"], "left_semi")

    def shared_names(symbols: DataFrame, name: str) -> DataFrame:
        """One Spark round: (id, th, shared), the numbers of the symbols whose names stand in two texts or more."""
        occurrences = symbols.select("id", "th", F.posexplode("symbols").alias("i", "s"))
        # Written first: the join then reads two plain sides, of which Spark splits the hot one.
        both = scratch.keep(occurrences.groupBy("s").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a != b").select("s"), f"{name} names")
        scratch.release()
        return occurrences.join(both, "s").groupBy("id", "th").agg(F.collect_set("i").alias("shared"))

    once = scratch.keep(once, "once")
    scratch.drop("parsed")
    marks = shared_names(once, "first").unionByName(once.where("blind").select("id", "th", F.array().cast("array<int>").alias("shared")))
    marks = scratch.keep(marks.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared")), "marks")
    scratch.drop("once", "first names")
    scratch.release()

    def open_windows(level: Levels, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of the windows that hold none of the symbols."""
        place, owner = starts_of(level.first, level.counts, window)
        fine = uncovered(level.lo[barred], level.hi[barred], len(level.words), window)[place]
        return place[fine], owner[fine]

    def deepen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                level = Levels(part.column(2).to_pylist(), rounds)
                _, owner = open_windows(level, level.bar_unshared(part.column(3)))
                if len(owner):
                    level.rise(MORE)
                    take = pa.array(np.unique(owner))
                    yield pa.RecordBatch.from_arrays([c.take(take) for c in [*part.columns, level.lists()]], names=["id", "th", "txt", "shared", "symbols"])

    texts = rows.select("id", "th", "txt").join(marks, ["id", "th"]).dropDuplicates(["id", "th"])
    opened = scratch.keep(texts.mapInArrow(tidy(deepen), "id long, th long, txt string, shared array<int>, symbols array<long>"), "opened")
    scratch.drop("marks")
    scratch.release()
    again = scratch.keep(shared_names(opened, "second").withColumnRenamed("shared", "above"), "above")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                level = Levels(part.column(2).to_pylist(), rounds)
                unshared = level.bar_unshared(part.column(3))
                place, owner = open_windows(level, unshared)
                level.rise(MORE)
                above = level.bar_unshared(part.column(4))
                fine = uncovered(level.lo[above], level.hi[above], len(level.words), window)[place]
                place, owner = place[fine], owner[fine]
                if len(place):
                    take, n = np.unique(owner, return_counts=True)
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    chosen = part.take(pa.array(take))
                    lists = [(place - level.first[owner]).astype(np.int32), _some(level.words, place, window).view(np.int64), level.check(place, window)]
                    yield pa.RecordBatch.from_arrays([*chosen.columns[:3], *(pa.ListArray.from_arrays(offsets, x) for x in lists)], names=["id", "th", "txt", "at", "number", "verify"])

    given = opened.drop("symbols").join(again, ["id", "th"], "left").withColumn("above", F.coalesce("above", F.array().cast("array<int>")))
    numbered = scratch.keep(given.mapInArrow(tidy(number), "id long, th long, txt string, at array<int>, number array<long>, verify array<int>"), "numbered")
    scratch.drop("opened", "above", "second names")
    scratch.release()
    windows = numbered.select("id", "th", F.explode(F.arrays_zip("at", "number", "verify")).alias("w")).select("id", "th", "w.at", "w.number", "w.verify")
    least = scratch.keep(windows.groupBy("number", "verify").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most").select("number", "verify", "least"), "least")
    scratch.release()
    hits = windows.join(least, ["number", "verify"]).where("id > least").groupBy("id", "th").agg(F.collect_set("at").alias("starts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(2), batch.column(3)):
                words, at_ = split_words(text.as_py()), np.sort(starts.values.to_numpy(zero_copy_only=False))
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at_, 1)
                np.add.at(change, at_ + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out.append((int(gone.sum()), _digest([w for w, g in zip(words, gone.tolist()) if not g]), [{"from": a, "to": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]))
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), span)))], names=["id", "th", "n_removed", "kept", "removed"])

    removed_kind = "array<struct<from:bigint,to:bigint>>"
    partly = numbered.select("id", "th", "txt").join(hits, ["id", "th"]).mapInArrow(tidy(remove), f"id long, th long, n_removed long, kept string, removed {removed_kind}")
    partly = scratch.keep(partly, "partly")
    scratch.release()
    whole = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to"))).cast(removed_kind)
    done = known.join(partly, ["id", "th"], "left")
    return done.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(whole, everything).otherwise(F.coalesce("removed", F.array().cast(removed_kind))).alias("removed"),
    )


def _some(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the windows of n words at the given starts."""
    if len(starts) * 4 > len(words):
        return sequence_numbers(words, n)[starts]
    total = words[starts].copy()
    for k in range(1, n):
        total = total * _A + words[starts + k]
    return mix(total)


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(documents).drop("removed")
