"""Extractive and template summaries, sentence ranking, and the scores of summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.functions.text import clean_light, coverage, sentences_by_dot, sentences_segmented, strip, word_set, words


def first_sentences(text: Column, n: int = 3) -> Column:
    """The first sentences of more than ten characters, or a fixed message."""
    found = F.slice(F.filter(sentences_by_dot(text), lambda s: F.length(s) > 10), 1, n)
    return F.when(F.size(found) > 0, F.concat(F.array_join(found, ". "), F.lit("."))).otherwise(lx.NO_SUMMARY)


def template_summary(text: Column) -> Column:
    n = F.size(words(text))
    return F.when(n < 50, lx.TOO_SHORT).otherwise(F.format_string(lx.ABSTRACT, n.cast("string")))


def summary_response(docs: DataFrame, kind: str = "extractive", text_col: str = "text") -> DataFrame:
    """``docs`` with the served summary and its lengths; with both kinds there is no single length."""
    text = F.col(text_col)
    kinds = {"extractive": first_sentences(text), "abstractive": template_summary(text)}
    chosen = list(kinds) if kind == "both" else [kind]
    docs = docs.withColumns({f"{name}_summary": kinds[name] for name in chosen})
    length = F.lit(None).cast("int") if kind == "both" else F.length(f"{kind}_summary")
    return docs.withColumn("original_length", F.length(text)).withColumn("summary_length", length)


def compression(summary: Column, text: Column) -> Column:
    return F.try_divide(F.length(summary), F.length(text))


def rank_sentences(vectors: np.ndarray, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-4) -> np.ndarray:
    """Page rank of sentences on the graph of their cosines."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    weights = unit @ unit.T
    np.fill_diagonal(weights, 0)
    n = len(weights)
    out = weights.sum(1)
    hangs = out == 0
    moves = weights / np.where(hangs, 1, out)[:, None]
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        before = rank
        rank = damping * (before @ moves + before[hangs].sum() / n) + (1 - damping) / n
        if np.abs(rank - before).sum() < n * tolerance:
            break
    return rank


def bag_of_words(sentences: list[str], width: int = 256) -> np.ndarray:
    """Hashed counts of words: the embedding where no model is given."""
    import zlib

    out = np.zeros((len(sentences), width))
    for i, sentence in enumerate(sentences):
        for word in sentence.lower().split():
            out[i, zlib.crc32(word.encode()) % width] += 1
    return out


def textrank(docs: DataFrame, n: int = 3, embed=bag_of_words, text_col: str = "text", out: str = "summary") -> DataFrame:
    """``docs`` with the n best sentences in their order; texts of no more sentences are left as they are.

    ``embed`` takes a list of sentences and gives a row for each; it is called in the workers.
    """
    found = F.filter(sentences_segmented(clean_light(strip(F.col(text_col)))), lambda s: F.size(words(s)) > 3)

    @F.arrow_udf("string")
    def best(texts: pa.Array, cut: pa.Array) -> pa.Array:
        rows = []
        for text, sentences in zip(texts.to_pylist(), cut.to_pylist(), strict=True):
            if sentences and len(sentences) > n:
                ranks = rank_sentences(embed(sentences))
                chosen = sorted(sorted(range(len(sentences)), key=lambda i: (-ranks[i], i))[:n])
                text = " ".join(sentences[i] for i in chosen)
            rows.append(text)
        return pa.array(rows, pa.string())

    return docs.withColumn(out, best(F.col(text_col), found))


def summary_quality(similarity: Column, summary: Column, text: Column, places: int | None = 3) -> Column:
    """Similarity, words taken from the text, and compression, in one number of three places."""
    taken = coverage(word_set(summary), word_set(text))
    short = F.least(F.lit(1.0), F.try_divide(F.lit(0.3), compression(summary, text)))
    score = similarity * 0.5 + taken * 0.3 + F.coalesce(short, F.lit(0.0)) * 0.2
    return score if places is None else F.bround(score, places)


def better_summary(text: Column, extractive: Column, abstractive: Column, similar_e: Column, similar_a: Column) -> Column:
    """The summary with the better similarity after a penalty for lengths off a fifth of the text."""
    target = F.length(text) * 0.2

    def score(summary: Column, similar: Column, weight: float) -> Column:
        return similar * weight - F.coalesce(F.try_divide(F.abs(F.length(summary) - target), target), F.lit(0.0)) * 0.1

    return F.when(score(extractive, similar_e, 0.7) > score(abstractive, similar_a, 0.6), extractive).otherwise(abstractive)


def export_summary(filename: Column, extractive: Column, abstractive: Column, word_count: Column, language: Column, added: Column) -> Column:
    """The text of a summary's export file."""
    missing = F.lit("Non disponible")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Résumé du document: "), filename),
        F.lit(""),
        F.lit("RÉSUMÉ EXTRACTIF:"),
        F.coalesce(F.nullif(extractive, F.lit("")), missing),
        F.lit(""),
        F.lit("RÉSUMÉ ABSTRACTIF:"),
        F.coalesce(F.nullif(abstractive, F.lit("")), missing),
        F.lit(""),
        F.lit("STATISTIQUES:"),
        F.concat(F.lit("- Nombre de mots: "), word_count.cast("string")),
        F.concat(F.lit("- Langue détectée: "), language),
        F.concat(F.lit("- Date d'ajout: "), F.date_format(added, "dd/MM/yyyy")),
    )
