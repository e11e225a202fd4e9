"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import alignment, bpe, jaccard, language, licenses, mixing, neighbours, pieces, quality, resampling, substrings, tokens, warc
from .common import table
from .oracle import ORACLE  # noqa: F401


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


def op2_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_tokens(spark, sf_dir):
    import public_tokenizers

    return tokens.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_substrings(spark, sf_dir):
    return substrings.substrings(table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op8_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), word_bpe_path())


def op11_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_alignment(spark, sf_dir):
    return alignment.scored(table(spark, sf_dir, "documents"), byte_bpe_path(), piece_bpe_path())


def op13_pieces(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), piece_bpe_path())


QUERIES = {
    "op1_warc": op1_warc, "op2_mixing": op2_mixing, "op3_jaccard": op3_jaccard, "op4_quality": op4_quality,
    "op5_tokens": op5_tokens, "op6_licenses": op6_licenses, "op7_language": op7_language, "op8_neighbours": op8_neighbours, "op9_bpe": op9_bpe, "op10_substrings": op10_substrings,
    "op11_resampling": op11_resampling, "op12_alignment": op12_alignment, "op13_pieces": op13_pieces,
}
