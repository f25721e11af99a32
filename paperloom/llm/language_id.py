"""Language ID: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties
and calibrated by a temperature.

Features are hashed 1- to 3-grams of lower-cased letters, every other character
being a space. Document frequencies come from all training documents; weights
are fitted on a bounded sample of labelled rows. Prediction folds idf and
weights into one table, so a text's scores are sums of table rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import Ftrl, softmax, temperature
from .mixing import uniform
from .shared import bounded_memory, held_out, release

BITS = 16
SIZES = 3
SCALE = 100.0
MOST_PER_LANGUAGE = 1500  # bound of the sample that weights are fitted on
MOST_CHARS = 1 << 16  # characters of the longest text that weights are fitted on
EPOCHS = 4
PIECE = 1 << 20  # characters worked on at a time
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_SPACE = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case letter or space for every code of the basic plane."""
    out = np.full(1 << 16, _SPACE, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letters()[np.minimum(raw, 0xFFFF)]
    for high in np.unique(raw[raw > 0xFFFF]).tolist():
        out[raw == high] = high if chr(high).isalpha() else _SPACE
    return out


def grams(c: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams that start at each code; spaces follow the last."""
    padded = np.concatenate([c, np.full(SIZES - 1, _SPACE, np.uint32)])
    h, out = np.zeros(len(c), np.uint32), []
    for n in range(SIZES):
        h = (h ^ padded[n : n + len(c)]) * np.uint32(_MULTIPLIERS[n])
        h ^= h >> np.uint32(15)
        out.append(h >> np.uint32(32 - BITS))
    return out


def _pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Codes of a piece with what its last n-grams reach into, and how many of
    its n-grams count."""
    for at in range(0, len(text), PIECE):
        yield codes(text[at : at + PIECE + SIZES - 1]), min(PIECE, len(text) - at)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(1 << BITS)
    for c, own in _pieces(text):
        for g in grams(c):
            counts += np.bincount(g[:own], minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, SIZES * len(text)) * idf[at] * SCALE


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, heat: float):
        self.languages, self.table, self.heat = languages, table, heat

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, text in enumerate(texts):
            for c, own in _pieces(text):
                for g in grams(c):
                    out[i] += np.take(self.table, g[:own], axis=0).sum(axis=0, dtype=np.float64)
            out[i] /= max(1, SIZES * len(text))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t)) and self.languages]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if live:
            p = softmax(self.scores([texts[i] for i in live]) / self.heat)
            for i, row in zip(live, p):
                names[i], score[i] = self.languages[int(row.argmax())], float(row.max())
        return names, score


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, seen = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
    for pdf in batches:
        for text in pdf["text"]:
            seen[:] = False
            for c, own in _pieces(text):
                for g in grams(c):
                    seen[g[:own]] = True
            total += seen
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "df": total[at]})


def train(labelled: DataFrame, most: int = MOST_PER_LANGUAGE, epochs: int = EPOCHS, most_chars: int = MOST_CHARS) -> Model:
    """labelled: (doc_id, text, lang), no nulls in text and lang. Languages are
    the values of lang. Weights are fitted on whole texts of at most most_chars
    characters: about `most` of each language, drawn by a hash of the id, the
    least text of each (id, language). A language without texts that short is
    learned from document frequencies alone."""
    bounded_memory(labelled.sparkSession)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), 1.0)
    frequencies = labelled.select("text").mapInPandas(_document_frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << BITS)
    df[frequencies["gram"]] = frequencies["df"]
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, most / counts[k]))])
    drawn = labelled.filter((uniform(F.col("doc_id")) < share[F.col("lang")]) & (F.length("text") <= most_chars))
    sent = labelled.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [features(t, sent.value) for t in batch["text"].to_pylist()]
            lists = [pa.array([x[0].astype(np.int32) for x in told], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in told], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], *lists], ["doc_id", "lang", "at", "x"])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    sample = drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", "text")
    sample = sample.mapInArrow(vectors, f"doc_id {kind}, lang string, at array<int>, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")]).combine_chunks()
    lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (sample.column("at").combine_chunks(), sample.column("x").combine_chunks())]
    rows = [tuple(values[o[i] : o[i + 1]] for o, values in lists) for i in range(sample.num_rows)]
    labels = [languages.index(k) for k in sample.column("lang").to_pylist()]
    back = [i for i in range(len(rows)) if i % 5 == 4]
    fit = [i for i in range(len(rows)) if i % 5 != 4]
    w = Ftrl(1 << BITS, len(languages)).fit([rows[i] for i in fit], [labels[i] for i in fit], epochs)
    held = np.array([rows[i][1] @ w[rows[i][0]] for i in back]).reshape(len(back), len(languages))
    del sample, lists, rows
    release()
    heat = temperature(held, np.array([labels[i] for i in back], int))
    return Model(languages, np.ascontiguousarray(w * idf[:, None] * SCALE, np.float32), heat)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score (replacing columns of these names)."""
    bounded_memory(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 rows x languages
    schema = "lang_pred string, score double"

    def of(texts: pd.Series) -> pd.DataFrame:
        names, score = sent.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": score})

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    found = docs.withColumn("_found", F.pandas_udf(of, schema)(F.col(text_col)))
    return found.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_PER_LANGUAGE) -> DataFrame:
    """One row for each row of docs: id_col, held_out, lang_pred, score.

    Trained on the rows of docs that are not held out and have text and a
    language. Null texts and texts without a letter are `und` with score 0; so
    is everything when nothing is labelled. score is the calibrated probability
    of lang_pred; equal scores go to the first language in order. Repeated rows
    get equal answers. Texts of any length are looked at in bounded pieces. An
    empty table gives an empty result; other columns are ignored, whatever their
    names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = rows.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = train(labelled, most)
    found = predict(rows.select("doc_id", "text"), model)
    return found.select(F.col("doc_id").alias(id_col), held_out().alias("held_out"), "lang_pred", "score")
