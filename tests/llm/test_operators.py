"""The operators against brute force on small tables with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re

import pytest

from trailgrid.llm import ann, audio, bpe, jaccard, language, mixing, pii, sharding, substrings, urls

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, size string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(60):
        w = base[: rng.randrange(40, 300)] if i % 3 else [f"x{rng.randrange(900)}" for _ in range(rng.randrange(120))]
        for _ in range(i % 4):
            w[rng.randrange(len(w) or 1) if w else 0 :][:1] = ["changed"]
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, "a", "b"))
    rows += [(90, None, None, None, None, None), (91, "", "en", "s1", "a", "b"), (92, rows[4][1], "en", "s0", "a", "b"), (93, "a b", None, "s9", None, None), (92, rows[4][1], "en", "s0", "a", "b"), (94, "x" * 5000, "en", "s0", "a", "b")]
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe_as_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    for r in bpe.digests(docs, bpe.vocabulary_path()).collect():
        want = ids[r.doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_language(docs):
    got = {r.doc_id: r for r in language.predictions(docs).collect()}
    assert got[90].lang_pred == got[91].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language.predictions(docs.limit(0)).count() == 0


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and rows and all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - g) <= 1 for t, g in by.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pii_base_kinds():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(1)
    for _ in range(3000):
        x = "".join(rng.choice("ab.@@1237 -+()4") for _ in range(rng.randrange(50)))
        found = pii.base_spans(x)
        assert found["email"] == [m.span() for m in re.finditer(plain["email"], x)]
        assert found["phone"] == [m.span() for m in re.finditer(plain["phone"], x) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    assert pii.base_spans("4111 1111 1111 1111 and 1.2.3.4 and 1.2.3.999")["ip"] == [(24, 31)]
    assert len(pii.base_spans("4111 1111 1111 1111")["card"]) == 1


def test_pii_report(docs):
    assert pii.report(docs).where("spans is null or base_sha256 is null").count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/de/1", "<link rel='canonical' href='http://b.net/x'>"), (2, "http://b.net/x/", ""), (3, "https://d.net/y", None), (4, None, None), (5, "https://org/x", "")], "page_id int, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages).collect()} == {1: ("com/de/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/", "allow")}


def test_audio(docs):
    for r in audio.report(docs).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
    assert audio.from_wav(audio.to_wav(b"abc" * 40)) == b"abc" * 40


def test_shards(docs):
    rows = sharding.report(docs).collect()
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_shards_where_every_text_is_copied(spark):
    """No document is free: shards have no room, and groups come together by swaps."""
    texts = spark.createDataFrame([(i, f"text {i // 5}") for i in range(8000)], "doc_id long, text string")
    rows = sharding.report(texts).collect()
    held = {}
    for r in rows:
        held.setdefault(r.doc_id // 5, []).append(r.shard)
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert sizes == [1000] * 8
    assert sum(max(map(x.count, x)) for x in held.values()) >= 0.95 * 8000


def test_moves_that_full_shards_grant():
    assert sharding.granted({(0, 1): 50, (2, 1): 50, (1, 0): 50}, [0, 0, 0]) == {(0, 1): 50, (2, 1): 0, (1, 0): 50}
    assert sharding.granted({(0, 1): 9, (1, 2): 7}, [0, 0, 5]) == {(0, 1): 5, (1, 2): 5}
    assert sharding.granted({(0, 1): 9, (2, 1): 9}, [0, 4, -3]) == {(0, 1): 0, (2, 1): 4}


def test_jaccard(docs):
    sets = {}
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        w = re.findall(WORD, r.text or "")
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = [r.doc_id for r in rows]
    near = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {a: sum(near(a, b) for b in ids) - bool(sets[a]) for a in sets}
    assert {r.doc_id: r.n_links for r in jaccard.join(docs).collect()} == want


def test_substrings(docs):
    words = {r.doc_id: re.findall(WORD, r.text or "") for r in docs.select("doc_id", "text").collect()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    for r in substrings.report(docs).collect():
        w = words[r.doc_id]
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < r.doc_id for q in range(p, p + 50)}
        assert r.n_removed == len(gone) and r.kept_sha256 == hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()


def test_ann(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0] * 8), (361, [1.0] * 8)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.query_id for r in got} == {*range(0, 200, 20), 360} and min(r.rank for r in got) == 1
    assert any(r.query_id == 360 and r.vec_id == 361 for r in got)
