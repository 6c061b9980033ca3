"""Every operator on empty tables and on rows with nulls in any column, repeats, a very long text and columns named like its own."""

import pytest

from trailgrid.llm import ann, audio, bpe, jaccard, language, mixing, pii, sharding, substrings, urls

#: Extra columns have names that the operators use inside.
EXTRA = ("id", "txt", "th", "size", "key", "node", "root", "term", "n", "shard", "score", "kind", "copies")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
OPERATORS = {
    "bpe": lambda d: bpe.digests(d, bpe.vocabulary_path()), "language": language.predictions, "mixing": mixing.mix, "pii": pii.report, "audio": audio.report,
    "sharding": sharding.report, "jaccard": jaccard.join, "substrings": substrings.report,
}


def rows():
    text = " ".join(f"w{i % 97} t{i % 53}" for i in range(400))
    made = [(1, text, "en", "a", 1), (2, text + " end", "en", "b", 2), (3, None, None, None, None), (4, "", "fr", "a", 0), (None, "an orphan text of words", "en", None, 3), (None, None, None, None, None), (5, " \t\n", "fr", "", 0), (6, "long " * 60_000 + "x" * 100_000, "fr", "b", 9), (7, "un deux trois été 12", "fr", "a", 5)]
    return [(*r, *["x"] * len(EXTRA)) for r in [*made, made[0]]]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = OPERATORS[name](docs).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows()), key=str)
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1 or name in ("mixing", "sharding")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, score double, rank int, query_id long"
    assert ann.search(spark.createDataFrame([], kind)).collect() == []
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (20, [0.0, 0.0])]
    got = ann.search(spark.createDataFrame([(*r, 0.5, 1, 9) for r in odd], kind)).collect()
    assert {r.query_id for r in got} == {0} and {r.vec_id for r in got} >= {1} and all(r.score == 1.0 for r in got)


def test_pages(spark):
    kind = "page_id long, url string, html string, host string, node string, root string"
    assert urls.judge(spark.createDataFrame([], kind)).collect() == []
    odd = [(1, None, None), (None, "http://a.com/de/", None), (2, "://", ""), (2, "://", ""), (3, "http://A.com/de", "<link rel=canonical href=>")]
    got = urls.judge(spark.createDataFrame([(*r, "h", "n", "r") for r in odd], kind)).collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == sorted([("1", "", "", None, "allow"), ("None", "a.com", "/de/", "com/de/", "block"), ("2", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "a.com", "/de", None, "block")], key=str)
