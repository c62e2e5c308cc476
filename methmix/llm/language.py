"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs within it.

A text is a vector of hashed byte 1- to 4-grams of its lowered UTF-8 form, square roots of counts at length 1. Linear
support vector machines tell the families apart pair by pair; within the winning family others tell its
languages apart. The machines are fitted on the driver from at most SAMPLE_PER_LANGUAGE labelled documents
of each language, those with the smallest hash of the id; every text is scored whole, where it lies.

A null text and one without a letter get `und` and score 0. Rows without label or id are never learned from. Repeated
rows are scored each. Without labelled rows everything is `und`. Texts of any length are read whole. An empty table
gives an empty result. Input columns are kept, but for those with the name of a column made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methmix.llm.common import table, without
from methmix.llm.registry import query
from methmix.llm.words import slices

# The fit is bounded: so many documents of each language, of whatever number there are, ...
SAMPLE_PER_LANGUAGE = 250
# ... and so many languages; more raise an error.
MOST_LANGUAGES = 200
DIMENSIONS = 4096
GRAMS = (1, 2, 3, 4)
COST = 10.0
EPOCHS = 40
UNDETERMINED = "und"
MADE = ("lang_pred", "score")

# Language families by ISO 639-1 code. A language of no family here joins `other`.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nl", "nb", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu", "se"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indo-iranian": ["bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ps", "sd", "si", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "sinitic": ["yue", "zh"],
    "austronesian": ["fil", "id", "jv", "mg", "ms", "tl"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], "other")


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed codes of the n-grams that start at each byte."""
    x = data.astype(np.uint32)
    code = np.zeros(len(x), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = code[:len(x) - n + 1] * np.uint32(0x01000193) ^ (x[n - 1:] + np.uint32(n))
        if len(code) and n in GRAMS:
            yield (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def features(texts: list[str]) -> np.ndarray:
    """(texts, DIMENSIONS) float32, rows of length 1 (0 for an empty text)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in enumerate(texts):
        data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
        counts = np.zeros(DIMENSIONS)
        # Pieces overlap by one byte less than the longest gram; what they count twice is no more than that.
        for at in range(0, len(data), 1 << 20):
            for codes in _grams(data[at:at + (1 << 20)]):
                counts += np.bincount(codes, minlength=DIMENSIONS)
        out[row] = np.sqrt(counts)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def fit_svm(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of a linear SVM with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    # Both sides weigh the same, whatever their numbers.
    cost = COST * len(y) / 2 / np.where(positive, positive.sum(), (~positive).sum())
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    diagonal = (x * x).sum(axis=1) + 0.5 / cost
    draw = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in draw.permutation(len(y)):
            gradient = y[i] * (x[i] @ weights) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


class Machines:
    """One-versus-one machines between classes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((len(self.pairs), x.shape[1] + 1), np.float32)
        for k, (a, b) in enumerate(self.pairs):
            rows = (labels == self.classes[a]) | (labels == self.classes[b])
            self.weights[k] = fit_svm(x[rows], labels[rows] == self.classes[a])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the class with most votes, then most margin, then first; its confidence from 0 to 1."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, total = np.zeros((len(x), n)), np.zeros((len(x), n))
        least = np.full((len(x), n), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k].astype(np.float64)
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            total[:, a] += np.tanh(m)
            total[:, b] -= np.tanh(m)
            least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
        best = (votes + total / (4 * n)).argmax(axis=1)
        return best, 1 / (1 + np.exp(-2 * least[np.arange(len(x)), best]))


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: list[str]):
        langs_array = np.array(langs, dtype=object)
        families = np.array([family(lang) for lang in langs], dtype=object)
        self.families = Machines(x, families) if langs else None
        self.within = {f: Machines(x[families == f], langs_array[families == f]) for f in sorted(set(families.tolist()))}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t is not None and any(c.isalpha() for c in t)]
        if not rows or self.families is None:
            return found, scores
        x = features([texts[i] for i in rows])
        place, sure = self.families.predict(x)
        for k, name in enumerate(self.families.classes):
            some = np.flatnonzero(place == k)
            if len(some):
                inner, inner_sure = self.within[name].predict(x[some])
                for at, lang, confidence in zip(some, inner, sure[some] * inner_sure):
                    found[rows[at]], scores[rows[at]] = self.within[name].classes[lang], float(confidence)
        return found, scores


def held_out(id_col: str):
    """Whether a row is kept out of the fit; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from a bounded sample of `labelled`."""
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("__llm_lang")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), [])
    # About twice the sample passes a threshold on the hash; the smallest hashes of it are the sample.
    under = F.create_map(*[F.lit(v) for r in counts for v in (r["__llm_lang"], int(min(1, 2 * SAMPLE_PER_LANGUAGE / r["n"]) * (1 << 30)))])
    near = rows.filter(spread < under[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spread.alias("hash"), F.col(id_col).alias("id"))
    order = Window.partitionBy("lang").orderBy("hash", "id", "text")
    sample = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_PER_LANGUAGE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in made], pa.binary())],
                                             names=["lang", "x"])
    got = sample.select("lang", "text").mapInArrow(task, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], r["x"]))
    return LanguageModel(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), [r["lang"] for r in got])


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with lang_pred and score."""
    docs = without(docs, MADE)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found, scores = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(found, pa.string()),
                                              pa.array(scores, pa.float64())], names=[*(f.name for f in keep), *MADE])
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(task, T.StructType(keep + added))


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    """Learned outside the held-out third, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id")).select("doc_id", "text", "lang"))
    found = with_language(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")
