"""Language identification by string kernels.

The kernel of two texts is the share of byte n-grams (one to three, blended)
present in both.  Landmark texts give a Nyström feature map; one-versus-rest
kernel ridge regression is fitted on it; scoring is two matrix products for a
block of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridewell.llm.common import MARGIN, RANKS, text_slices

BASE = 64
SIZES = (BASE, BASE**2, BASE**3)
SPACE = sum(SIZES)
BLOCK = 64


def _classes() -> np.ndarray:
    """Byte to symbol: 1-26 for a-z in either case, 27-58 for what follows in
    a letter beyond ASCII (so Latin-1 capitals and small letters agree), 59-63
    for its first byte, 0 for all that separates."""
    out = np.zeros(256, np.int32)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[0x80:0xC0] = 27 + np.arange(64) % 32
    out[0xC0:0xE0] = 60
    out[0xC3] = 59
    out[0xD0:0xE0] = 61
    out[0xE0:0xF0] = 62
    out[0xF0:] = 63
    return out


CLASSES = _classes()


def gram_presence(data: np.ndarray, offsets: np.ndarray):
    """The distinct n-gram codes of each text of a slice; a run of what
    separates counts as one symbol."""
    codes = CLASSES[data]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    keep[offsets[:-1][offsets[:-1] < len(codes)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    one = codes[keep]
    two = one[:-1] * BASE + one[1:]
    three = two[:-1] * BASE + one[2:] + (BASE + BASE**2)
    two = two + BASE
    seen = np.zeros(SPACE, bool)
    for a, b in zip(at[:-1], at[1:]):
        seen[one[a:b]] = True
        seen[two[a : max(a, b - 1)]] = True
        seen[three[a : max(a, b - 2)]] = True
        seen[0] = False
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


class Model:
    """Landmark n-grams and the weights that turn kernels into class outputs."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = 40, ridge: float = 1e-3):
        self.langs = sorted(set(langs))
        sets = self._sets(texts)
        marks = []
        for lang in self.langs:
            own = [i for i, x in enumerate(langs) if x == lang and len(sets[i])]
            marks += own[:landmarks]
        self.row = np.full(SPACE, -1, np.int32)
        vocabulary = np.unique(np.concatenate([sets[i] for i in marks] or [np.zeros(0, np.int64)]))
        self.row[vocabulary] = np.arange(len(vocabulary))
        self.marks = np.zeros((len(vocabulary), len(marks)), np.float32)
        for j, i in enumerate(marks):
            self.marks[self.row[sets[i]], j] = 1 / np.sqrt(len(sets[i]))
        self.weights = np.zeros((len(marks), len(self.langs)), np.float32)
        if not marks:
            return
        kernel = self.kernels(sets).astype(float)
        values, vectors = np.linalg.eigh(kernel[marks])
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        z = kernel @ root
        y = np.array([[1.0 if x == lang else -1.0 for lang in self.langs] for x in langs])
        share = np.array([langs.count(x) for x in self.langs])
        balance = np.array([1 / share[self.langs.index(x)] for x in langs])
        gram = (z * balance[:, None]).T @ z + ridge * np.eye(z.shape[1])
        self.weights = (root @ np.linalg.solve(gram, (z * balance[:, None]).T @ y)).astype(
            np.float32
        )

    @staticmethod
    def _sets(texts: list[str]) -> list[np.ndarray]:
        out = []
        for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
            out += list(gram_presence(data, offsets))
        return out

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel of each set with each landmark, by blocks of texts."""
        out = np.zeros((len(sets), self.marks.shape[1]), np.float32)
        present = np.zeros((BLOCK, self.marks.shape[0]), np.float32)
        for lo in range(0, len(sets), BLOCK):
            block = sets[lo : lo + BLOCK]
            present[:] = 0
            for i, own in enumerate(block):
                at = self.row[own]
                present[i, at[at >= 0]] = 1 / np.sqrt(max(1, len(own)))
            out[lo : lo + BLOCK] = (present @ self.marks)[: len(block)]
        return out

    def outputs(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernels(sets) @ self.weights


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def train(
    docs: DataFrame,
    per_language: int = 400,
    landmarks: int = 40,
    text_col="text",
    lang_col="lang",
    languages: int = 200,
) -> Model:
    """Fit on at most ``per_language`` texts of each of at most ``languages``
    languages (the most frequent, ties by name), those of least hash of id and
    text (documented bounds; landmarks are the first of these).  Null texts and
    languages teach nothing; an empty table gives a model that knows none."""
    key = F.xxhash64(F.xxhash64("doc_id"), F.col("text"))
    known = docs.select(
        F.col("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where("lang is not null and text is not null")
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # A language's rows under a threshold that follows from their number, so
    # that no task sorts a whole language; of these the least.
    ranked = known.select("lang", key.alias("key")).join(F.broadcast(most), "lang")
    low = F.pmod("key", F.lit(RANKS)) < F.lit(float(RANKS)) * MARGIN * per_language / F.col("n")
    order = Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(RANKS)), "key")
    rows = ranked.where(low).select("lang", "key").distinct().withColumn("n", F.row_number().over(order))
    rows = rows.where(F.col("n") <= per_language).drop("n")
    chosen = (
        known.withColumn("key", key)
        .join(F.broadcast(rows), ["lang", "key"])  # per_language rows a language at most
        .select("lang", "key", "text")
        .dropDuplicates(["lang", "key"])
        .orderBy("key", "lang")
        .toPandas()
    )
    usable = [has_letter(x) for x in chosen["text"]]
    chosen = chosen[np.array(usable, bool)]
    return Model(chosen["text"].tolist(), chosen["lang"].tolist(), landmarks)


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1, share of the
    softmax of the class outputs).  Null texts and texts without a letter give
    'und' and 0; so does every text if nothing was learned.  Null ids and
    repeated rows stay; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            names, scores = [], []
            for lo, hi, data, offsets in text_slices(column):
                sets = list(gram_presence(data, offsets))
                raw = model.outputs(sets) if model.langs else np.zeros((len(sets), 1))
                best = raw.argmax(1)
                top = np.exp(4 * (raw - raw.max(1, keepdims=True)))
                share = top.max(1) / top.sum(1)
                ascii_letter = np.concatenate(
                    [[0], np.cumsum((CLASSES[data] > 0) & (CLASSES[data] < 27))]
                )
                for i in range(hi - lo):
                    a, b = offsets[i], offsets[i + 1]
                    known = ascii_letter[b] > ascii_letter[a] or (
                        b > a and has_letter(column[lo + i].as_py())
                    )
                    ok = bool(known and model.langs)
                    names.append(model.langs[best[i]] if ok else "und")
                    scores.append(float(share[i]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")
