"""Documents of files, rows and columns; term and vector search; vector indexes of lists; caches of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A term, and how many terms a vocabulary holds.
TERM, VOCABULARY = r"\b(\w\w+)\b", 512


def row_document(df: DataFrame) -> Column:
    """`column: value | ...` of a row; nulls are empty."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])


def column_documents(df: DataFrame, order: str, samples: int = 5) -> DataFrame:
    """(column_no, name, document): each column with its values in the first rows by `order`, blanks left out."""
    first = df.orderBy(order).limit(samples)  # a handful of rows
    cells = F.array(*[F.struct(F.lit(i).alias("column_no"), F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for i, c in enumerate(df.columns)])
    rows = first.select(F.col(order).alias("o"), F.explode(cells).alias("c")).select("o", "c.*")
    values = F.transform(F.array_sort(F.collect_list(F.when(F.trim("v") != "", F.struct("o", "v")))), lambda x: x["v"])
    return rows.groupBy("column_no", "name").agg(values.alias("vs")).select("column_no", "name", F.concat_ws(": ", "name", F.array_join("vs", ", ")).alias("document"))


def term_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    terms = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), F.lit(1)))
    return texts.select(F.col(id_col).alias("id"), terms.alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """((id, term, weight) with unit norm for each id, vocabulary (term, idf)): smoothed idf over the terms most frequent in the corpus."""
    n = texts.count()
    counts = term_counts(texts, id_col, text_col)
    vocabulary = counts.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(size)
    vocabulary = vocabulary.select("term", (F.ln(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(F.broadcast(vocabulary), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))  # at most `size` rows
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight")), vocabulary


def tfidf_search(texts: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the k texts nearest to a query by cosine of tf-idf, ties to the smaller id."""
    spark = texts.sparkSession
    vectors, vocabulary = tfidf(texts, id_col, text_col)
    asked = term_counts(spark.createDataFrame([(0, query)], "q long, t string"), "q", "t").join(vocabulary, "term").select("term", (F.col("tf") * F.col("idf")).alias("w"))
    whole = asked.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = asked.crossJoin(F.broadcast(whole)).select("term", (F.col("w") / F.col("norm")).alias("qw"))  # the terms of one query
    return vectors.join(F.broadcast(asked), "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """(qid, rank, id, score) by inner product. corpus: (id, v); queries: (qid, q), which are counted before they are broadcast.

    Each task keeps its own best k of each query, so that the shuffle carries k rows a task and query at most.
    """
    n = queries.count()
    if n > most:
        raise ValueError(f"{n} queries, more than the {most} that are compared at a time; ask in blocks")
    scored = corpus.crossJoin(F.broadcast(queries)).select("qid", "id", dot(F.col("v"), F.col("q")).alias("score"))
    order = [F.desc("score"), "id"]
    part = scored.withColumn("part", F.spark_partition_id())
    near = part.withColumn("r", F.row_number().over(Window.partitionBy("qid", "part").orderBy(*order))).where(F.col("r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def checked(df: DataFrame, most: int, what: str) -> DataFrame:
    """df marked for broadcast, after its rows were counted."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} {what}; ask in blocks")
    return F.broadcast(df)


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, score): late interaction, the sum over query tokens (qt, q) of the best inner product with a document's tokens (id, v)."""
    best = doc_tokens.crossJoin(checked(query_tokens, most, "query tokens")).groupBy("id", "qt").agg(F.max(dot(F.col("v"), F.col("q"))).alias("m"))
    return best.groupBy("id").agg(F.sum("m").alias("score"))


def rerank(found: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, k: int) -> DataFrame:
    """(id, score): the k best of found (id) by late interaction, ties to the smaller id."""
    return max_sim(query_tokens, doc_tokens.join(found.select("id").distinct(), "id", "left_semi")).orderBy(F.desc("score"), "id").limit(k)


def file_documents(lines: DataFrame, path: str = "path", sheet: str = "sheet", first: int = 5, most: int = 20_000) -> DataFrame:
    """(path, sheet, document): name, path and first lines of each sheet (path, sheet, line_no, content), cut to `most` characters; sheet '' has no name."""
    head = lines.where(F.col("line_no") <= first).groupBy(path, sheet).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "\n").alias("shown"))
    name = F.regexp_extract(F.col(path), r"[^/]*$", 0)
    named = F.when(F.coalesce(F.col(sheet), F.lit("")) != "", F.concat(name, F.lit("-[sheet: "), F.col(sheet), F.lit("]"))).otherwise(name)
    body = F.when(F.length("shown") > most, F.concat(F.left("shown", F.lit(most)), F.lit("...(truncated)"))).otherwise(F.col("shown"))
    return head.select(path, sheet, F.concat(F.lit("Table Name: "), named, F.lit("\nTable Path: "), F.col(path), F.lit("\nTable Content Preview:\n"), body).alias("document"))


def row_blocks(lines: DataFrame, budget: int = 512, key: str = "path", count: Callable[[str], int] = lambda s: len(s.split())) -> DataFrame:
    """(key, row, n, text): lines (key, line_no, content) after the first two, in blocks whose cost with the header keeps the budget.

    Every block but the first starts with the last line of the one before; a block holds one line at least. `row` is the
    number of its first line. A file is packed by one task in one pass, which holds no more than a block.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head, block, spent = None, [], [], 0
        made: list[tuple] = []
        text = lambda: "Header data:\n" + "\n".join(head) + "\n-------\nSpecific table data:\n"
        close = lambda: made.append((now, block[0][0], len(block), text() + "\n".join(c for _, c in block)))
        for batch in batches:
            for k, no, content in zip(batch["k"], batch["line_no"], batch["content"]):
                if k != now:
                    if block:
                        close()
                    now, head, block, spent = k, [], [], 0
                if len(head) < 2:
                    head.append(content)
                    spent = count(text())
                    continue
                cost = count(content)
                if spent + cost > budget and block:
                    close()
                    block, spent = [block[-1]], count(text()) + count(block[-1][1])
                block.append((no, content))
                spent += cost
            if made:
                yield pd.DataFrame(made, columns=["key", "row", "n", "text"])
                made.clear()
        if block:
            close()
            yield pd.DataFrame(made, columns=["key", "row", "n", "text"])

    kind = lines.schema[key].dataType.simpleString()
    rows = lines.select(F.col(key).alias("k"), F.col("line_no").cast("long").alias("line_no"), "content").repartition("k").sortWithinPartitions("k", "line_no")
    return rows.mapInPandas(pack, f"key {kind}, row long, n long, text string").withColumnRenamed("key", key)


def unencoded(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct texts that a cache (hash, v) lacks: all that must be encoded."""
    return texts.select(F.md5(text_col).alias("hash"), text_col).where(F.col(text_col).isNotNull()).dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")


def with_vectors(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """texts with `v` of a cache (hash, v), null where it is unknown."""
    return texts.withColumn("hash", F.md5(text_col)).join(cache, "hash", "left").drop("hash")


def kept_since(cache: DataFrame, least: Column) -> DataFrame:
    """Entries (…, made) of a cache made at or after a time."""
    return cache.where(F.col("made") >= least)


def unit_vectors(df: DataFrame, v: str = "v") -> DataFrame:
    """df with vectors of norm 1; a zero vector stays."""
    norm = F.sqrt(dot(F.col(v), F.col(v)))
    return df.withColumn("_norm", F.when(norm > 0, norm).otherwise(1.0)).withColumn(v, F.transform(v, lambda c: c.cast("double") / F.col("_norm"))).drop("_norm")


def list_count(n: int) -> int:
    return max(1, min(100, n // 10))


def build_lists(corpus: DataFrame, seed: int = 1, sample: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """((list, centre), (list, id, v)) of corpus (id, v) with unit vectors: k-means on a sample by hash of at most about `sample` vectors, then every vector goes to its nearest centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = unit_vectors(corpus)
    n = unit.count()
    drawn = unit.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1)))).select(array_to_vector("v").alias("features"))
    model = KMeans(k=list_count(n), seed=seed, maxIter=10).fit(drawn if n > 1 else drawn.unionAll(drawn))
    centres = corpus.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")  # 100 rows at most
    return centres, nearest_lists(unit, centres, 1).select("list", "id", "v")


def nearest_lists(vectors: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """vectors (..., v) with the n nearest lists of centres (list, centre), which are few and broadcast, a row each."""
    held = centres.orderBy("list").toPandas()  # 100 rows at most
    points, names = np.stack(held["centre"].to_numpy()), held["list"].to_numpy()

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy())
        d = (points**2).sum(1) - 2 * x @ points.T
        return pd.Series(list(names[np.argsort(d, axis=1, kind="stable")[:, :n]].astype("int32")))

    return vectors.withColumn("list", F.explode(near(F.col("v"))))


def search_lists(lists: DataFrame, centres: DataFrame, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
    """(qid, rank, id, score): the k best of the `probes` lists nearest to each query (qid, q), by inner product of unit vectors."""
    asked = nearest_lists(unit_vectors(queries.withColumnRenamed("q", "v")), centres, probes).select("qid", "list", F.col("v").alias("q"))
    scored = lists.join(asked, "list").select("qid", "id", dot(F.col("v"), F.col("q")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def save_lists(lists: DataFrame, centres: DataFrame, to: str) -> None:
    """An index as Parquet, its lists as partitions, so that a search reads only those that it probes."""
    lists.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{to}/lists")
    centres.coalesce(1).write.mode("overwrite").parquet(f"{to}/centres")


def load_lists(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """(centres, lists) of a saved index."""
    return spark.read.parquet(f"{at}/centres"), spark.read.parquet(f"{at}/lists")


def near_by_hash(corpus: DataFrame, query: list[float], k: int, bucket: float = 1.0, hashes: int = 8, seed: int = 1) -> DataFrame:
    """(id, distance): approximately the k nearest of unit vectors (id, v), by random projections; stands in for a graph index, which Spark has not."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = unit_vectors(corpus).select("id", array_to_vector("v").alias("x"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=bucket, numHashTables=hashes, seed=seed).fit(rows)
    length = float(np.linalg.norm(query)) or 1.0
    return model.approxNearestNeighbors(rows, Vectors.dense([x / length for x in query]), k, distCol="distance").select("id", "distance")


#: Search engines by name: (texts, query, k, id column, text column) to (id, score). A model's encoder is registered by whoever has one.
ENGINES: dict[str, Callable] = {"tfidf": tfidf_search}


def search(texts: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text", engine: str = "tfidf") -> DataFrame:
    """(id, score) by the engine of a name."""
    return ENGINES[engine](texts, query, k, id_col, text_col)
