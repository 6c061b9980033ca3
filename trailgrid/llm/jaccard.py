"""N-gram Jaccard join by chosen paths.

Texts are sets of runs of five words. In each run of the join a set walks down a path of tokens: at a
node the set's least token under the node's hash order, which two sets share with the probability
of their similarity. Nodes of at most SMALL sets are compared by brute force; larger ones split again,
at most DEPTH times. Runs are repeated until a pair at the threshold that always meets large nodes is
found with probability RECALL. Comparing starts with sketches; what passes is linked provisionally,
and within the components of these links pairs are checked exactly, from the texts.

Texts with equal sets are one class, told by 128 bits and the size of the set, and joined once. Large
nodes are compared block by block, and every block passes on a spanning forest, never its pairs. A
component of more than EXACT_BLOCK classes or EXACT_TOKENS tokens is cut into blocks of alike classes, and
only blocks between which a sketch passed are compared, so a long chain of links costs its links and
not its square; every pair of blocks gives a forest and counts.

Defined cases: a text of one to four words is one run of them all; a null or wordless text is linked
to nothing, and its class is its own id; rows with a null id take part, and only a component of none
but null ids has a null class_id; repeated rows, and different texts under one id, are documents of
their own; ids may be of any type that can be ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, mix, tidy
from .graph import components
from .tokens import batch_numbers, sequence_numbers

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Sets of a node that are compared at once; splits of a larger node; sets of a block of either comparison.
SMALL, DEPTH, SKETCH_BLOCK, EXACT_BLOCK = 64, 3, 512, 512
#: Tokens of a block that is compared exactly (a longer text is a block of its own).
EXACT_TOKENS = 400_000
#: Coordinates of a sketch, two bits each, and how far below the threshold it may be (over four standard deviations).
COORDS, SLACK = 128, 0.18
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - THRESHOLD**DEPTH))
_SALTS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PAIR = np.uint64(0x5555555555555555)


def shingles(numbers: np.ndarray, n: int = N) -> np.ndarray:
    """The set of runs of n words of a text, sorted; of a shorter text the run of all."""
    return np.unique(sequence_numbers(numbers, n if len(numbers) >= n else len(numbers))) if len(numbers) else numbers


def minima(tokens: np.ndarray) -> np.ndarray:
    """For each coordinate the token that is least under its hash order (as its hash)."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 2048):
        np.minimum(out, (tokens[at : at + 2048, None] * _SALTS).min(0), out=out)
    return mix(out)


def sketch_of(least: np.ndarray) -> bytes:
    bits = (least & np.uint64(3)).reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(bits, axis=1).tobytes()


def paths(least: np.ndarray) -> np.ndarray:
    """(RUNS, DEPTH) names of the nodes that a set passes."""
    names = np.zeros((RUNS, DEPTH), np.uint64)
    node = mix(np.arange(1, RUNS + 1, dtype=np.uint64))
    for d in range(DEPTH):
        node = mix(node * np.uint64(0xA0761D6478BD642F) + least[(np.arange(RUNS) * DEPTH + d) % COORDS])
        names[:, d] = node
    return names.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row (broadcast)."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & _PAIR).sum(-1)
    return 1 - differ / (COORDS * 0.75)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of whole groups (equal in the first `keys` columns) of sorted batches; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        opens = bool(held) and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys))
        if opens:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held = [batch.slice(int(new[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links: (root, member) of each component."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = np.flatnonzero(linked[root] & left)
        while len(front):
            left[front] = False
            out += [(root, int(m)) for m in front]
            front = np.flatnonzero(linked[front].any(0) & left)
    return out


def _blocked(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of df (with `n`, the size of their group) dealt to pairs of blocks of their group: columns bi <= bj, own block."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("rep", key), blocks).cast("int")
    with_ = df.withColumn("blocks", blocks).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("bi"), F.greatest(o, F.col("own")).alias("bj")))
    return with_.withColumn("b", F.explode(pairs)).withColumns({"bi": F.col("b.bi"), "bj": F.col("b.bj")}).drop("b", "blocks")


def _passing(part: pa.Table):
    """Of rows node, bi, bj, own, rep, size, sketch, ...: (i, j) row numbers that may be at the threshold, and dense matrices of large groups."""
    node, bi, bj, size = (part.column(i).to_numpy() for i in (0, 1, 2, 5))
    marks = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint64).reshape(len(node), -1)
    begin = np.concatenate([[0], np.flatnonzero((node[1:] != node[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1, [len(node)]])
    count = np.diff(begin)
    fits = lambda i, j: (alike(marks[i], marks[j]) >= THRESHOLD - SLACK) & (np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j]))
    few, group, pairs, dense = np.repeat(count <= 8, count), np.repeat(begin[:-1], count), [], []
    for d in range(1, min(8, len(node))):
        i = np.flatnonzero(few[:-d] & (group[:-d] == group[d:]))
        if not len(i):
            break
        i = i[fits(i, i + d)]
        pairs.append((i, i + d))
    for g in np.flatnonzero(count > 8):
        at = np.arange(begin[g], begin[g + 1])
        linked = np.stack([fits(i, at) for i in at])
        np.fill_diagonal(linked, False)
        dense.append((at, linked))
    return pairs, dense


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, bi, bj, own, rep, size, sketch in order of the first three: provisional links, a forest of each large group."""
    for part in _groups(batches, 3):
        rep = part.column(4).to_numpy()
        pairs, dense = _passing(part)
        out = [(rep[i], rep[j]) for i, j in pairs]
        for at, linked in dense:
            made = np.array(_forest(linked), int).reshape(-1, 2)
            out.append((rep[at[made[:, 0]]], rep[at[made[:, 1]]]))
        if out:
            a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, bi, bj, own, rep, size, sketch, comp, block in order of the first three: pairs of blocks of which a sketch passed."""
    for part in _groups(batches, 3):
        comp, block = part.column(7).to_numpy(), part.column(8).to_numpy()
        pairs, dense = _passing(part)
        for at, linked in dense:
            _, first, kind = np.unique(block[at], return_index=True, return_inverse=True)
            met = np.zeros((len(first), len(first)), bool)
            i, j = np.nonzero(linked)
            met[kind[i], kind[j]] = True
            i, j = np.nonzero(met)
            pairs.append((at[first[i]], at[first[j]]))
        if pairs:
            i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            told = np.unique(np.stack([comp[i], np.minimum(block[i], block[j]), np.maximum(block[i], block[j])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=["comp", "bi", "bj"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of sizes of common parts."""
    m = len(sets)
    if m <= 4:
        out = np.zeros((m, m))
        for i in range(m):
            out[i, i] = len(sets[i])
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    kind = np.cumsum(np.concatenate([[0], tokens[1:] != tokens[:-1]]))
    often = np.bincount(kind) > 1
    keep = often[kind]
    kind, owner = (np.cumsum(often) - 1)[kind[keep]], owner[keep]
    out = np.zeros((m, m), np.float32)
    for at in range(0, int(kind[-1]) + 1 if len(kind) else 0, 8192):
        a, b = np.searchsorted(kind, [at, at + 8192])
        held = np.zeros((m, 8192), np.float32)
        held[owner[a:b], kind[a:b] - at] = 1
        out += held @ held.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _exact_links(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """comp, bi, bj, own, rep, copies, text in order of the first three: (a, b, 0) forest links and (rep, null, linked documents)."""
        for table in _groups(batches, 3):
            comp, bi, bj, own, rep, copies = (table.column(i).to_numpy() for i in range(6))
            begin = np.concatenate([[0], np.flatnonzero((comp[1:] != comp[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1, [len(comp)]])
            a, b, w = [], [], []
            for lo, hi in zip(begin, begin[1:]):
                numbers, counts = batch_numbers(table.column(6).slice(lo, hi - lo).to_pylist())
                sets = [shingles(x, n) for x in np.split(numbers, np.cumsum(counts)[:-1])]
                sizes = np.array([len(s) for s in sets], float)
                common = overlaps(sets)
                linked = common >= threshold * (sizes[:, None] + sizes - common) - 1e-9
                np.fill_diagonal(linked, False)
                if bi[lo] != bj[lo]:
                    linked &= own[lo:hi, None] != own[lo:hi]
                forest = _forest(linked)
                a += [rep[lo + i] for i, _ in forest]
                b += [rep[lo + j] for _, j in forest]
                w += [0] * len(forest)
                total = linked @ copies[lo:hi]
                for i in np.flatnonzero(total):
                    a.append(rep[lo + i])
                    b.append(None)
                    w.append(int(total[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], names=["a", "b", "w"])

    return run


def _dealt(members: DataFrame, small: DataFrame, scratch: Scratch) -> DataFrame:
    """members (rep, root, size, c0, ...) dealt to pairs of blocks of their component: comp, bi <= bj, own."""
    stats = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    blocks = lambda n, tokens: F.greatest(F.ceil(F.col(n) / EXACT_BLOCK), F.ceil(F.col(tokens) / EXACT_TOKENS))
    known = members.join(stats, "root").withColumn("parts", blocks("n", "tokens"))
    whole = known.where("parts = 1").select("*", F.col("root").alias("comp"), *[F.lit(0).cast("long").alias(c) for c in ("bi", "bj", "own")])
    # Classes with one first node are likely alike: large clusters of them get blocks of their own, small ones share.
    clusters = known.where("parts > 1").groupBy("root", "c0").agg(F.count("*").alias("cn"), F.sum("size").alias("ct"))
    cut = known.where("parts > 1").join(clusters, ["root", "c0"])
    large = (F.col("cn") * 4 > EXACT_BLOCK) | (F.col("ct") * 4 > EXACT_TOKENS)
    own = F.when(large, F.xxhash64("c0", F.pmod(F.xxhash64("rep"), blocks("cn", "ct")))).otherwise(F.pmod(F.xxhash64("c0"), 2 * F.col("parts")))
    cut = scratch.keep(cut.withColumn("own", own).withColumn("comp", F.col("root")).drop("cn", "ct"), "cut")
    if cut.isEmpty():
        return whole
    again = _blocked(small.join(cut.select("rep", "comp", F.col("own").alias("block")), "rep"), "node", SKETCH_BLOCK)
    again = again.select("node", "bi", "bj", "own", "rep", "size", "sketch", "comp", "block").repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj")
    met = scratch.keep(again.mapInArrow(tidy(_block_links), "comp long, bi long, bj long").distinct(), "blocks")
    sides = met.select("comp", F.col("bi").alias("own"), "bi", "bj").unionAll(met.where("bi != bj").select("comp", F.col("bj").alias("own"), "bi", "bj"))
    return whole.unionByName(cut.join(sides, ["comp", "own"]))


def join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, n_links): class_id the least document of its component of links, n_links the other documents at the threshold or above."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt")).select("id", F.xxhash64("txt").alias("th"), "txt")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                numbers, counts = batch_numbers(part.column(2).to_pylist())
                size, key, second, sketch, nodes = [], [], [], [], []
                for words in np.split(numbers, np.cumsum(counts)[:-1]):
                    tokens = shingles(words)
                    least = minima(tokens)
                    size.append(len(tokens))
                    key.append(int(np.add.reduce(mix(tokens)).view(np.int64)) if len(tokens) else 0)
                    second.append(int(np.bitwise_xor.reduce(mix(tokens * _SALTS[0])).view(np.int64)) if len(tokens) else 0)
                    sketch.append(sketch_of(least))
                    nodes.append(paths(least).ravel())
                offsets = np.arange(len(nodes) + 1, dtype=np.int32) * RUNS * DEPTH
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(second, pa.int64()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(offsets, np.concatenate(nodes))],
                    names=["id", "th", "size", "k1", "k2", "sketch", "nodes"],
                )

    signed = scratch.keep(rows.mapInArrow(tidy(sign), f"id {kind}, th long, size long, k1 long, k2 long, sketch binary, nodes array<long>"), "signed")
    keys = ["k1", "k2", "size"]
    # One row a class walks on. Its number is fixed by being written.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    classes = signed.where("size > 0").groupBy(*keys).agg(least.alias("first"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    path = F.explode(F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.slice("nodes", r * DEPTH + 1, DEPTH)))
    now, leaves = scratch.keep(classes.select("rep", "size", "sketch", path.alias("path")), "walk0"), []
    for depth in range(DEPTH):
        at = now.withColumn("node", F.element_at("path", depth + 1))
        sizes = at.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        met = at.join(sizes, "node")
        last = depth == DEPTH - 1
        leaves.append((met if last else met.where(F.col("n") <= SMALL)).select("node", "rep", "size", "sketch", "n"))
        if not last:
            now = scratch.keep(met.where(F.col("n") > SMALL).drop("node", "n"), f"walk{depth + 1}")
    small = leaves[0].unionAll(leaves[1]).unionAll(leaves[2])
    dealt = _blocked(small, "node", SKETCH_BLOCK).select("node", "bi", "bj", "own", "rep", "size", "sketch")
    met = dealt.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj")
    near = scratch.keep(components(met.mapInArrow(tidy(_sketch_links), "a long, b long"), "a", "b", scratch, "near"), "components")
    scratch.release()
    members = near.withColumnRenamed("node", "rep").join(classes.select("rep", "size", "copies", "first", F.get("nodes", F.lit(0)).alias("c0")), "rep")
    dealt = _dealt(scratch.keep(members, "members"), small, scratch)
    texts = rows.join(members.select("rep", F.col("first.id").alias("mid"), F.col("first.th").alias("mth")), F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth"))).select("rep", "txt").dropDuplicates(["rep"])
    dealt = dealt.select("comp", "bi", "bj", "own", "rep", "copies").join(texts, "rep").select("comp", "bi", "bj", "own", "rep", "copies", "txt")
    exact = scratch.keep(dealt.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj").mapInArrow(tidy(_exact_links(N, THRESHOLD)), "a long, b long, w long"), "exact")
    scratch.drop("walk0", "walk1", "walk2", "components", "members", "cut", "blocks")
    roots = scratch.keep(components(exact.where("b is not null"), "a", "b", scratch, "links"), "roots").withColumnRenamed("node", "rep")
    counts = exact.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("links"))
    firsts = roots.join(classes.select("rep", "first"), "rep").groupBy("root").agg(F.min("first")["id"].alias("least"))
    linked = roots.join(firsts, "root").join(counts, "rep", "left").select("rep", "root", "least", "links")
    ends = classes.select("rep", *keys, "copies", "first").join(linked, "rep", "left")
    ends = ends.select(*keys, F.when(F.col("root").isNull(), F.col("first.id")).otherwise(F.col("least")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    done = signed.select("id", *keys).join(ends, keys, "left")
    return done.select(F.col("id").alias(id_col), F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without those whose class has a lesser document (null ids last); repeated rows of the kept one stay once.

    Rows are told apart by a number of their own, so that null ids, and different texts under one id, are documents too.
    Wordless texts are in no class: of those only rows repeated with their id go. Columns may have any names.
    """
    scratch, columns = Scratch(documents.sparkSession, "kept"), documents.columns
    doc = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = documents.select(doc.alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("txt"), F.xxhash64(text_col).alias("mark"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows.drop("txt"), "rows").withColumn("txt", F.col(f"doc.c{columns.index(text_col)}"))
    linked = scratch.keep(join(rows.select("row", "txt"), "row", "txt").where("n_links > 0 or row != class_id").select("row", "class_id"), "linked")
    order = F.struct(F.col("id").isNull(), "id", "mark", "row")
    first = linked.join(rows.select("row", "id", "mark"), "row").groupBy("class_id").agg(F.min(order)["row"].alias("row"))
    bare = rows.where(F.col("id").isNotNull() & ~F.coalesce("txt", F.lit("")).rlike(WORD))
    once = bare.groupBy("id", "txt").agg(F.min("row").alias("row"))
    gone = linked.select("row").join(first, "row", "left_anti").unionAll(bare.select("row").join(once, "row", "left_anti"))
    return rows.join(gone, "row", "left_anti").select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(columns)])
