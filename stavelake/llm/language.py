"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, field, map_texts, stored, table

HASHES = 3
UNKNOWN = "und"
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """Which code points below U+40000 are letters (Unicode category L); there are none beyond."""
    return np.fromiter((chr(i).isalpha() for i in range(0x40000)), bool, 0x40000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(text: str, letters: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all n-grams of a lower-cased whole text, with other signs as one kind of gap; none without a letter."""
    cps = code_points(f" {text.lower()} ")
    is_letter = letters[np.minimum(cps, len(letters) - 1)]  # the last one is no letter
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one gap after each word
    keep[0] = True
    c = np.where(is_letter, cps, 32)[keep].astype(np.uint64)
    if not is_letter.any() or len(c) < width:
        return np.empty(0, np.uint64)
    h = np.zeros(len(c) - width + 1, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x20003) + c[i : len(c) - width + 1 + i]
    return h * MULTIPLY


@dataclass
class LanguageModel:
    """`rows[i]` has bit l % 64 of word l // 64 set if some n-gram of language l falls on row i.

    `cover[l]` is the share of all n-grams of l's own texts that its filter holds.
    """

    languages: list[str]
    rows: np.ndarray
    width: int
    prior: int
    cover: list[float]

    def __post_init__(self) -> None:
        self.false = np.array([((self.rows[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).mean() for b in range(len(self.languages))]) ** HASHES

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that may contain it: the AND of its rows, a word for 64 languages."""
        return self.rows[places(h, 0, len(self.rows))] & self.rows[places(h, 1, len(self.rows))] & self.rows[places(h, 2, len(self.rows))]

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of each text: per-language popcounts over the masks, less the expected false positives.

        The score is the best language's share of known n-grams against what its own texts have, 1 at most, so that a
        language with very many n-grams is not held to have a poor fit.
        """
        each = [grams(t or "", letters, self.width) for t in texts]
        sizes = np.array([len(g) for g in each])
        known = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        share = np.zeros((len(texts), len(self.languages)))
        if sizes.sum():
            masks, full = self.masks(np.concatenate(each)), np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            for b in range(len(self.languages)):
                hits = np.add.reduceat(((masks[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).astype(np.int64), starts)
                share[full, b] = (hits / sizes[full] - self.false[b]) / (1 - self.false[b])
        share = np.clip(share, 0, 1)
        best = np.where(share.max(1) > 0, share.argmax(1), self.prior)
        score = [min(1.0, float(share[i, b]) / max(self.cover[b], 1e-9)) for i, b in enumerate(best)]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], [x if k else 0.0 for x, k in zip(score, known)]


def places(h: np.ndarray, k: int, rows: int) -> np.ndarray:
    """Row of the k-th hash; rows is a power of two."""
    return ((h >> np.uint64(7 + 19 * k)) & np.uint64(rows - 1)).astype(np.int64)


def train_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_each: int = 1500, grams_each: int = 1000, width: int = 3) -> LanguageModel:
    """Fit filters on labelled texts.

    At most about `rows_each` different texts of each language are used (a documented bound, chosen by hash of the text).
    Spark counts their n-grams; each language keeps the `grams_each` (a bound too) with the highest count, weighed by how
    much more often it uses them than the languages together. Only those reach the driver. Any number of languages can
    be learned; the model grows with it, by 16 bits a kept n-gram.
    """
    labelled = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    totals = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    counts = {r["lang"]: r["rows"] for r in totals.collect()}
    if not counts:
        return LanguageModel([UNKNOWN], np.zeros((1 << 12, 1), np.uint64), width, 0, [1.0])
    languages = sorted(counts)
    step = F.greatest(F.floor(F.col("rows") / rows_each), F.lit(1))
    sample = labelled.join(F.broadcast(totals), "lang").where(F.pmod(F.xxhash64("text"), step) == 0).select("text", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for part in chunks(batch, "text"):
                own: dict[str, list[np.ndarray]] = {}
                for t, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    own.setdefault(name, []).append(grams(t, letters, width))
                for name, hs in own.items():
                    g, n = np.unique(np.concatenate(hs), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "g", "n"])

    seen = stored(sample.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    total = seen.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = seen.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    share = F.col("rate") / F.sum("rate").over(Window.partitionBy("g"))
    weighed = rate.withColumn("w", F.col("rate") * share)
    top = weighed.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("w"), "g"))).where(F.col("k") <= grams_each)
    chosen = top.select("lang", "g", "rate").toPandas()
    size = 1 << int(np.ceil(np.log2(16 * grams_each)))
    rows = np.zeros((size, -(-len(languages) // 64)), np.uint64)
    cover = []
    for b, name in enumerate(languages):
        own = chosen[chosen["lang"] == name]
        h = own["g"].to_numpy(np.int64).view(np.uint64)
        for k in range(HASHES):
            rows[np.unique(places(h, k, size)), b >> 6] |= np.uint64(1 << (b & 63))
        cover.append(float(own["rate"].sum()) or 1.0)
    return LanguageModel(languages, rows, width, max(range(len(languages)), key=lambda i: counts[languages[i]]), cover)


def predict_languages(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """`df` with the predicted language and a score from 0 to 1 for every whole text, in one pass without a shuffle.

    The model (128 KB for each 64 languages, whatever the corpus) goes to every task. Null texts and texts without a letter
    are `und` with score 0. A text that no filter knows gets the most frequent training language with score 0; ties go
    to the first language by name. Long texts are read whole. Repeated rows are judged each. Columns of the same names
    are replaced. Empty tables give none.
    """
    parts = (model.languages, model.rows, model.width, model.prior, model.cover)

    def make():
        own, letters = LanguageModel(*parts), letter_table()

        def predict(texts: list[str | None]) -> list[pa.Array]:
            names, scores = own.predict(texts, letters)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return predict

    return map_texts(df, make, [field(out, T.StringType()), field(score, T.DoubleType())], text, most=1 << 20)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def language_model(docs: DataFrame) -> LanguageModel:
    """The model for `documents`: learned from rows that are not held out."""
    return train_languages(docs.where(~held_out()))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict_languages(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
