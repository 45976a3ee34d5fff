"""Language identification with hyperdimensional n-gram profiles.

Method. Every letter has a random vector of +1 and -1 drawn from its own code point. A trigram
binds its letters' vectors, the first permuted twice and the second once, by multiplication; a
text bundles the vectors of all its trigrams by addition. A language's prototype is the sum of
the normalised vectors of its training texts; a text has the language of the prototype with the
largest cosine. Trigrams run over lower-cased letters, every run of other characters being one
space.

Training reads every row with a non-null label and a hash fold outside the held-out one; each
partition adds up its own sums, so what is gathered has one row for each language, dimension
and task. The prototypes (languages x DIMENSIONS floats) are collected: labels are a closed set,
and more than LANGUAGES_MAX of them raise.

Defined cases. Null texts and texts without a letter: `und`, score 0. Ties go to the smaller
language. No training rows: everything is `und`, score 0. Null doc_id: in no fold, so neither
held out nor learnt from. Score: the cosine, 0 at least and 1 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches, staged

DIMENSIONS = 1024
LANGUAGES_MAX = 4096
SEED = 10
#: Trigram vectors that a Python worker remembers.
TRIGRAMS_MAX = 16_384
UNKNOWN = "und"


@lru_cache(maxsize=4096)
def letter(code: int) -> np.ndarray:
    bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8)
    return (2 * bits - 1).astype(np.float32)


class Profiles:
    """Text vectors; remembers trigram vectors."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((TRIGRAMS_MAX, DIMENSIONS), np.int8)  # products of +1 and -1
        self.letters: dict[int, bool] = {}

    def _codes(self, text: str) -> np.ndarray:
        """Lower-cased letters with 32 for each run of other characters, one at both ends; empty without a letter."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = self.letters
        table = np.unique(cp)
        for c in table.tolist():
            if c not in known:
                known[c] = chr(c).isalpha()
        is_letter = np.array([known[c] for c in table.tolist()], bool)
        lut = np.where(is_letter, table, 32).astype(np.int64)
        codes = np.concatenate([[32], lut[np.searchsorted(table, cp)], [32]])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        return codes if len(codes) > 1 else codes[:0]

    def vector(self, text: str | None) -> np.ndarray | None:
        codes = self._codes(text) if text else np.zeros(0, np.int64)
        if not len(codes):
            return None
        grams, counts = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        out = np.zeros(DIMENSIONS, np.float32)
        for at in range(0, len(grams), TRIGRAMS_MAX):  # more trigrams than are remembered: in parts
            part = grams[at : at + TRIGRAMS_MAX].tolist()
            rows = self.rows
            new = [g for g in part if g not in rows]
            if len(rows) + len(new) > TRIGRAMS_MAX:
                rows.clear()
                new = part
            for g in new:
                rows[g] = i = len(rows)
                self.matrix[i] = np.roll(letter(g >> 42), 2) * np.roll(letter(g >> 21 & 0x1FFFFF), 1) * letter(g & 0x1FFFFF)
            out += counts[at : at + TRIGRAMS_MAX].astype(np.float32) @ self.matrix[[rows[g] for g in part]].astype(np.float32)
        return out / max(float(np.linalg.norm(out)), 1e-30)


@lru_cache(maxsize=1)
def profiles() -> Profiles:
    return Profiles()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3).cast("int")


def train(rows: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of rows(text, lang) with a label."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        p = profiles()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (v := p.vector(text)) is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(DIMENSIONS)
                    sums[lang] += v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v)], ["lang", "dim", "x"])

    parts = rows.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(run, "lang string, dim int, x double")
    sums = staged(parts.groupBy("lang", "dim").agg(F.sum("x").alias("x")), "prototypes")
    n = sums.where("dim = 0").count()
    if n > LANGUAGES_MAX:
        raise ValueError(f"{n} languages; at most {LANGUAGES_MAX} are expected")
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["x"]
    return {k: out[k] / max(float(np.linalg.norm(out[k])), 1e-30) for k in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """docs(text, ...) columns `keep` plus lang_pred and score, which take the place of columns of these names."""
    bounded_batches(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names]).reshape(-1, DIMENSIONS)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles()
        for b in batches:
            langs, scores = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                v = p.vector(text)
                if v is None or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cos = matrix @ v
                    best = int(np.argmax(cos))
                    langs.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cos[best]))))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(f"_{i}" for i in range(len(kept))), "lang_pred", "score"])

    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(kept)), F.col("text").alias("_text"))
    found = rows.mapInArrow(run, f"{schema}lang_pred string, score double")
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(kept)), "lang_pred", "score")


def identify(docs: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the labelled rows outside the held-out fold, predicts all."""
    held = F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False))
    prototypes = train(docs.where(F.coalesce(fold(F.col("doc_id")) != held_out_fold, F.lit(False))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return predict(rows, prototypes, ["doc_id", "held_out"])
