"""BPE encoding and decoding with a contiguous rank array per word.

A word is an array of parts. Beside it stands the array of the ranks of its adjacent pairs; the
least rank is found by a scan, its boundary deleted, and the two neighbouring ranks refreshed.
Words above LONG parts use a heap over a linked list instead, which merges in the same order
(least rank, then leftmost) without the scan's quadratic cost.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the id column is
carried as it is (null, repeated); other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: Parts above which a word is merged by a heap.
LONG = 192
#: Words that a Python worker remembers; beyond that its memory of words starts anew.
REMEMBERED = 400_000
_NONE = 1 << 62
_BITS = 24
_MASK = (1 << _BITS) - 1
#: A character outside those for which Python's and the tokenizer's lower case, normal forms and white space agree.
_RARE = re.compile("[^\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u017f]")
#: The tokenizer's pieces, for texts without such characters.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, from the text of a tokenizer file."""

    def __init__(self, spec: str):
        spec_json = json.loads(spec)
        model = spec_json["model"]
        self.spec, vocab, end = spec, model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec_json["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()], default=-1) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[(vocab[a] << _BITS) | vocab[b]] = (rank << _BITS) | vocab[a + b]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.seen: dict[str, array] = {}
        self._library = None

    def merge(self, parts: list[int]) -> list[int]:
        """parts by the rank array, in place."""
        if len(parts) > LONG:
            return self.merge_long(parts)
        rank = self.ranks.get
        ranks = [rank((a << _BITS) | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i] = least & _MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1] << _BITS) | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i] << _BITS) | parts[i + 1], _NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.ranks.get, []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := rank((parts[i] << _BITS) | parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = r & _MASK, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def word(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        return self.merge([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]])

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text with any characters."""
        if self._library is None:  # normal forms and word bounds of rare characters, as the library has them; no merges
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
            self._letter_byte = {c: b for b, c in enumerate(byte_letters())}
        t = self._library
        found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        back = self._letter_byte
        return [bytes(back[c] for c in letters).decode("utf-8", "surrogatepass") for letters, _ in found if letters]

    def _piece(self, piece: str, out: array) -> None:
        ids = self.seen.get(piece)
        if ids is None:
            ids = array("i", self.word(piece))
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(piece) <= 64:
                self.seen[piece] = ids
        out += ids

    def _plain(self, text: str, out: array) -> None:
        for p in self.pieces(text) if _RARE.search(text) else _PIECES.findall(text.lower()):
            self._piece(p, out)

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        if self.special_re is None or "<|" not in text:
            self._plain(text, out)
            return out
        at = 0
        for m in self.special_re.finditer(text):
            self._plain(text[at : m.start()], out)
            out.append(self.special[m[0]])
            at = m.end()
        self._plain(text[at:], out)
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does; ids that no token has are left out."""
        tokens = self.tokens
        return " ".join([t for i in ids if 0 <= i < len(tokens) and (t := tokens[i])])


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, ids array<int>) of every whole text. tokenizer: the path of a tokenizer file on the driver."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    carried = [id_col, *keep]
    names = [*[f"c{i}" for i in range(len(carried))], "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [np.frombuffer(bpe.encode(x.as_py()), dtype=np.int32) for x in part.column(len(carried))]
                offsets = np.cumsum([0, *map(len, made)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, np.concatenate(made))], names=names)

    schema = T.StructType([*[T.StructField(n, df.schema[c].dataType) for n, c in zip(names, carried)], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(*[F.col(c).alias(n) for n, c in zip(names, carried)], F.col(text_col).alias("txt")).mapInArrow(tidy(run), schema).toDF(*carried, "ids")


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of its ids as column `to`. Null ids decode to the empty text."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    place, columns = df.columns.index(ids_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(place)
                ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
                texts = pa.array([bpe.decode(flat[a:b].tolist()) if ok else "" for a, b, ok in zip(ends, ends[1:], ids.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*columns, to])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))


def digests(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of the round trip."""
    both = decode(encode(documents, tokenizer), tokenizer)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
