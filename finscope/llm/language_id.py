"""Language identification by the nearest of several centroids for each language.

A text is a normalised TF-IDF vector of its byte n-grams (one to three bytes,
ASCII letters in lower case, other ASCII as a space), hashed to `dim` places.
Each language has up to `clusters` centroids by spherical k-means; a text gets
the language of the centroid with the greatest cosine, and is rejected where it
is much further from it than sampled texts of its length are.

The classifier is fitted on about `per_language` labelled rows of each language,
picked by a hash of id and text: IDF, centroids and rejection all come from that
sample, whose size doesn't follow the table's. Prediction reads every text whole,
a very long one in stretches.

Defined cases: null text and text without a letter are `und` with score 0, and
rejected; rows without a language or with a null id are never learned from;
repeated rows are learned from once and judged alike; of centroids that are
equally near the one of the language first by name counts; with nothing to learn from, every row is `und`;
other columns pass through, and new ones replace equally named ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscope.llm.shared import appended, utf8, written

#: Bytes of a text that are counted at a time.
STRETCH = 1 << 21
UNKNOWN = "und"
#: Hashes are counted modulo this where a share of the rows is picked.
SPAN = 1 << 62

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def counts(raw: np.ndarray, dim: int) -> np.ndarray:
    """How often each hashed n-gram occurs in the bytes of a text."""
    total = np.zeros(dim, np.int64)
    shift = np.uint32(32 - (dim.bit_length() - 1))
    for first in range(0, len(raw), STRETCH):
        b = _FOLD[raw[first : first + STRETCH + 2]]
        n = min(STRETCH, len(raw) - first)
        grams = [b[:n] + np.uint32(1 << 24), (b[:-1] | b[1:] << np.uint32(8))[:n] + np.uint32(2 << 24), (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16))[:n] + np.uint32(3 << 24)]
        codes = np.concatenate(grams) * np.uint32(2654435761) >> shift
        total += np.bincount(codes, minlength=dim)
    return total


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf).astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from the texts furthest from those chosen before."""
    chosen = [x.mean(axis=0)]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[np.argmin((x @ np.array(chosen).T).max(axis=1))])
    c = np.array(chosen)
    for _ in range(rounds):
        own = (x @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) for i in np.unique(own)])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class LanguageModel:
    """langs: of each centroid. floor: least score that is accepted, by the bit length of a text's size in bytes."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the nearest centroid, its cosine)."""
        scores = vectors(tf, self.idf) @ self.centroids.T
        best = scores.argmax(axis=1)
        return best, np.clip(scores[np.arange(len(best)), best], 0, 1)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(id_col: str = "doc_id") -> Column:
    """True for a quarter of the ids, which are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of about `per_language` rows of each language, those whose hash is below its share of the language's rows.

    Only a count for each language is aggregated, and one scan picks the rows;
    none is ranked or sent to where its language is. Repeated rows count once.
    """
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & has_letter(F.col(text_col)) & ~held_out(id_col))
    usable = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    below = [(r["lang"], int(SPAN * min(1.0, per_language / r["n"]))) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not below:
        return usable.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for pair in below for x in pair])
    return usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SPAN)) < F.element_at(share, F.col("lang"))).distinct().select("lang", "text")


def _matrix(texts, dim: int) -> np.ndarray:
    return np.array([counts(np.frombuffer(t.encode(), np.uint8), dim) for t in texts])


def stretches(texts, bits: int) -> list[bytes]:
    """A stretch of each longer text whose size in bytes has this bit length, cut between characters; only those with a letter."""
    out = []
    for text in texts:
        raw = text.encode()
        at = crc32(raw)
        size = (1 << (bits - 1)) + at % (1 << (bits - 1))
        if len(raw) > size:
            first = at % (len(raw) - size)
            cut = raw[first : first + size].decode(errors="ignore")
            if any(map(str.isalpha, cut)):
                out.append(cut.encode())
    return out


def fit(docs: DataFrame, per_language: int = 400, clusters: int = 4, dim: int = 4096, margin: float = 0.4, least_bytes: int = 128, **columns) -> LanguageModel:
    """Fit on a bounded sample. A text of at least `least_bytes` is rejected below `margin` times the median score of its length band.

    Shorter ones vary more: their floor is that, or the score that all but one in
    200 reach, whichever is less, of stretches of their length out of the sample.
    """
    sample = written(training_rows(docs, per_language, **columns).repartition("lang"), "language-sample")

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(pdf)], "df": [(_matrix(pdf["text"], dim) > 0).sum(axis=0)]})

    parts = sample.groupBy("lang").applyInPandas(frequencies, "n long, df array<bigint>").toPandas()
    if not len(parts):
        return LanguageModel([], np.zeros((0, dim), np.float32), np.zeros(dim, np.float32), np.zeros(65))
    df = np.sum([np.array(x) for x in parts["df"]], axis=0)
    idf = np.log((1 + parts["n"].sum()) / (1 + df)).astype(np.float32)

    short = (least_bytes - 1).bit_length()

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        x = vectors(_matrix(pdf["text"], dim), idf)
        c = centroids(x, clusters)
        best = (x @ c.T).max(axis=1)
        bits = [len(t.encode()).bit_length() for t in pdf["text"]]
        # Stretches have the band's number below zero.
        for band in range(1, short + 1):
            if cut := stretches(pdf["text"], band):
                own = vectors(np.array([counts(np.frombuffer(t, np.uint8), dim) for t in cut]), idf) @ c.T
                best, bits = np.append(best, own.max(axis=1)), bits + [-band] * len(cut)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": [c.ravel()], "scores": [best.astype(float)], "bits": [bits]})

    made = sample.groupBy("lang").applyInPandas(grouped, "lang string, c array<float>, scores array<double>, bits array<bigint>").toPandas().sort_values("lang")
    all_c = [np.array(c, np.float32).reshape(-1, dim) for c in made["c"]]
    scores, bits = np.concatenate([np.array(x) for x in made["scores"]]), np.concatenate([np.array(x) for x in made["bits"]])
    # A band takes in those beside it, so that a rare length has enough texts to compare with; a band without any is as strict as the one before.
    floor = np.zeros(65)
    for band in range(1, 65):
        near = scores[(np.abs(bits - band) <= 1) & (bits > 0)]
        floor[band] = np.median(near) * margin if len(near) >= 20 else floor[band - 1]
    for band in range(short + 1):
        cut = scores[bits == -band] if band else scores[:0]
        floor[band] = min(np.median(cut) * margin, np.quantile(cut, 0.005)) if len(cut) >= 20 else 0
    return LanguageModel([lang for lang, c in zip(made["lang"], all_c) for _ in range(len(c))], np.concatenate(all_c), idf, floor)


def predicted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (string), score (double, 0 to 1) and lang_rejected (boolean)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size: languages x clusters x dim, whatever the table's

    def start():
        own = shared.value
        langs = np.array([*own.langs, UNKNOWN], object)
        dim = len(own.idf)

        def work(batch: pa.RecordBatch):
            raw, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
            n = batch.num_rows
            if not own.langs or not n:
                return [pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.array([True] * n)]
            tf = np.array([counts(raw[offsets[i] : offsets[i + 1]], dim) for i in range(n)])
            best, score = own.predict(tf)
            bits = np.array([int(x).bit_length() for x in np.diff(offsets)])
            return [pa.array(langs[best].tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.array(score < own.floor[bits])]

        return work

    out = appended(docs, "lang_pred string, score double, lang_rejected boolean", start)
    known = has_letter(F.col(text_col))
    return out.withColumns({
        "lang_pred": F.when(known, F.col("lang_pred")).otherwise(UNKNOWN),
        "score": F.when(known, F.col("score")).otherwise(0.0),
        "lang_rejected": ~known | F.col("lang_rejected"),
    })
