"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from . import ann, audio, bpe, jaccard, language, mixing, oracles, pii, sharding, substrings, urls
from .common import load


def op1_bpe_rank_array(spark, sf_dir):
    return bpe.digests(load(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op2_language_ppm(spark, sf_dir):
    return language.predictions(load(spark, sf_dir, "documents"))


def op3_pivotal_mixing(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_pii_spans(spark, sf_dir):
    return pii.report(load(spark, sf_dir, "documents"))


def op5_url_redirects(spark, sf_dir):
    return urls.judge(load(spark, sf_dir, "pages"))


def op6_audio_features(spark, sf_dir):
    return audio.report(load(spark, sf_dir, "documents"))


def op7_label_propagation(spark, sf_dir):
    return sharding.report(load(spark, sf_dir, "documents"))


def op8_chosen_path_join(spark, sf_dir):
    return jaccard.join(load(spark, sf_dir, "documents"))


def op9_posting_lists(spark, sf_dir):
    return ann.search(load(spark, sf_dir, "embeddings"))


def op10_recompression(spark, sf_dir):
    return substrings.report(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_rank_array, op2_language_ppm, op3_pivotal_mixing, op4_pii_spans, op5_url_redirects, op6_audio_features, op7_label_propagation, op8_chosen_path_join, op9_posting_lists, op10_recompression)}
#: The others fit models, draw at random, search approximately or go through libraries: tests hold them against brute force.
ORACLES: dict[str, str] = {"op5_url_redirects": oracles.URLS, "op8_chosen_path_join": oracles.NEAR, "op10_recompression": oracles.REPEATS}
