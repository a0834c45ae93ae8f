"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is the elementwise product (binding) of its letters' vectors,
each rotated by its place; a text is the sum (bundle) of its n-grams' vectors, and so is the prototype of a language over all
of its texts. Random vectors are nearly orthogonal, so the cosine of a text with a prototype tells how much of its
n-gram profile they share.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfabric.llm.common import bound_batches
from riskfabric.llm.worker import give_back, kept_in_worker

DIMENSIONS = 512
GRAM = 3
SEED = 20240607
#: 0 stands for everything between words, 1 to 26 for a to z, the rest is shared by all other letters.
SYMBOLS = 64
UNKNOWN = "und"
KEPT = "language_profiles"


def symbol_table() -> np.ndarray:
    """Symbol of each code point; those that are no letter have 0."""
    points = np.arange(sys.maxunicode + 1, dtype=np.int32)
    letters = np.fromiter((chr(i).isalpha() for i in range(len(points))), bool, len(points))
    out = np.where(letters, 27 + points % (SYMBOLS - 27), 0)
    out[97:123] = np.arange(1, 27)
    return out.astype(np.uint8)


class Profiles:
    """Bundles of whole texts."""

    def __init__(self, dimensions: int = DIMENSIONS):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.places = [np.roll(letters, GRAM - 1 - i, axis=1) for i in range(GRAM)]
        self.symbols = symbol_table()
        self.dimensions = dimensions

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the vectors of all letter trigrams, with one mark at word ends; None without a letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        marks = np.zeros(len(points) + 2, np.int32)
        marks[1:-1] = self.symbols[points]
        if not marks.any():
            return None
        marks = marks[(marks > 0) | np.r_[True, marks[:-1] > 0]]  # one mark between words
        if marks[-1]:
            marks = np.r_[marks, 0]
        codes, counts = np.unique((marks[:-2] * SYMBOLS + marks[1:-1]) * SYMBOLS + marks[2:], return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(codes), 8192):
            part = codes[i:i + 8192]
            grams = self.places[0][part // SYMBOLS**2] * self.places[1][part // SYMBOLS % SYMBOLS] * self.places[2][part % SYMBOLS]
            total += counts[i:i + 8192].astype(np.float32) @ grams.astype(np.float32)
        return total


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A prototype of unit length for each language of the labelled rows; rows without text, letter or language are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = kept_in_worker(KEPT, Profiles), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (bundle := profiles.bundle(text.as_py())) is not None:
                    sums[lang] = sums.get(lang, 0) + bundle.astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["_lang", "_at", "_sum"])

    rows = labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_text is not null and _lang is not null")
    bound_batches(labelled.sparkSession)
    sums = rows.mapInArrow(give_back(run, KEPT), "_lang string, _at int, _sum long").groupBy("_lang", "_at").agg(F.sum("_sum").alias("_sum"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions rows
        found.setdefault(r["_lang"], np.zeros(DIMENSIONS))[r["_at"]] = r["_sum"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if v.any()}


def predicted(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct(`lang_pred`, `score`): the language of the largest cosine (ties to the first by name) and that cosine, from 0 to 1.

    `und` with score 0 for null, for texts without a letter, and where nothing was learned.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiles = kept_in_worker(KEPT, Profiles)
        for column in columns:
            langs, scores = [], []
            for text in column:
                bundle = profiles.bundle(text.as_py()) if names else None
                lang, score = UNKNOWN, 0.0
                if bundle is not None:
                    cosines = matrix @ bundle
                    best = int(cosines.argmax())
                    length = float(np.linalg.norm(bundle))
                    lang, score = names[best], min(1.0, max(0.0, float(cosines[best]) / length)) if length else 0.0
                langs.append(lang)
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    whole = give_back(run, KEPT)
    whole.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return F.arrow_udf(whole, kind)(text)


def held_out(id_column: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `part`; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with `held_out`, `lang_pred` and `score`, learned from the rows that are not held out and have a language.

    One row per input row; repeated rows are learned from as often as they are there. The language, like all columns but the
    text, has no part in a prediction. Only texts are sent to Python.
    """
    prototypes = learn(docs.filter(~held_out(F.col(id_col), 4, 2)), text_col, lang_col)
    return docs.withColumns({"held_out": held_out(F.col(id_col), 4, 2), "_language": predicted(F.col(text_col), prototypes)}).withColumns(
        {"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")
