"""The pipeline's stages in turn against brute force on what each is given, held-out accuracy, recall, and clashing columns."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from trailgrid.llm import ann, bpe, language, pii

WORD = r"[^\x20\x09-\x0D]+"
WORDS = {"en": "the of and house with that this water from have they would there which time people".split(), "fr": "le de et maison avec que cette eau depuis avoir ils serait il quel temps gens".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "fr"
        text = " ".join(f"{rng.choice(WORDS[lang])}{rng.choice(['', '', 's'])}" for _ in range(rng.randrange(30, 90)))
        rows.append((i, text, lang if i % 5 else None, f"s{i % 3}" if i % 7 else None, len(text), "x", 1))
    rows += [(100 + k, rows[k][1] + (" more" if k % 2 else ""), "en", "s0", 0, "y", 2) for k in range(20)]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s1", 0, "x", 1), (202, "12 34 ...", "fr", "s1", 9, None, None), (203, rows[3][1] + " mail bob@example.com", "en", "s2", 0, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score int")


def shingles(text):
    w = re.findall(WORD, text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark, docs):
    from tokenizers import Tokenizer

    library, given = Tokenizer.from_file(bpe.vocabulary_path()), docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, "")
        before, after = given.collect(), made.collect()
        old = {r.doc_id: r for r in before}
        if name != "tokens":
            assert made.columns == given.columns
        if name == "language ID":
            model = language.learn(given)
            found = {r.doc_id: model.predict(r.text) for r in before}
            assert sorted(r.doc_id for r in after) == sorted(i for i, f in found.items() if f[0] != "und" and f[3])
            assert not {200, 201, 202} & {r.doc_id for r in after} and {*range(80)} <= {r.doc_id for r in after}
        elif name == "near duplicates":
            sets = {i: shingles(r.text) for i, r in old.items()}
            root = {i: i for i in old}
            for a in sorted(old):
                for b in sorted(old):
                    if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                        lo, hi = sorted((root[a], root[b]))
                        root = {i: lo if r == hi else r for i, r in root.items()}
            assert sorted(r.doc_id for r in after) == sorted({*root.values()})
        elif name == "personal data":
            assert {r.doc_id: r.text for r in after} == {i: r.text and pii.masked(r.text, pii.spans(r.text)) for i, r in old.items()}
        elif name == "mixing":
            size = lambda r: len(re.findall(WORD, r.text or ""))
            taken = {}
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + size(r)
            whole = {}
            for r in before:
                whole[r.source] = whole.get(r.source, 0) + size(r)
            assert all(0 < n <= 2 * whole[s] + 1 for s, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(whole.values())) <= len(whole) + 1
        else:
            assert sorted((r.doc_id, r.n_tokens, r.ids) for r in after) == sorted((r.doc_id, len(x), x) for r in before for x in [library.encode(r.text or "", add_special_tokens=False).ids])
        given = spark.createDataFrame(after, made.schema)


def test_pipeline_of_an_empty_table(spark, docs):
    spark.conf.get("spark.checkpoint.dir")
    given = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, "")
    assert given.count() == 0


def test_held_out_accuracy(docs):
    known = {r.doc_id: r.lang for r in docs.collect() if r.lang and r.doc_id < 80}
    told = [r for r in language.predictions(docs).collect() if r.held_out and r.doc_id in known]
    assert len(told) > 5 and np.mean([r.lang_pred == known[r.doc_id] for r in told]) >= 0.9


def test_recall(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    got = ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    exact = v.astype(np.float64) @ v.T.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        best = [i for i in np.lexsort((np.arange(1500), -exact[q])) if i != q][:20]
        hits += len({*best} & {r.vec_id for r in got if r.query_id == q})
    assert hits / (75 * 20) >= 0.9


def test_near_duplicates_without_ids_of_their_own(spark):
    """Null ids and ids shared by different texts: of each class one row stays, and no other row goes."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    rows = [(1, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["b"] + " more"), (None, text["c"]), (None, text["d"]), (5, text["e"]), (5, text["f"]), (5, text["e"]), (7, text["g"]), (6, text["g"] + " end")]
    rows += [(None, None), (None, ""), (8, None), (8, None), (8, " ")]
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()]
    alike = [r for r in kept if r[1] and r[1].startswith(text["b"])]
    assert len(alike) == 1 and alike[0] in rows
    rest = [(1, text["a"]), (None, text["c"]), (None, text["d"]), (5, text["e"]), (5, text["f"]), (6, text["g"] + " end"), (None, None), (None, ""), (8, None), (8, " ")]
    assert sorted(map(str, kept)) == sorted(map(str, [*rest, *alike]))
