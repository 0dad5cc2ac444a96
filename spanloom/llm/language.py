"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed character 1- to 3-grams of the lower-cased text with white space runs as one space,
weighted by term frequency (share of all n-grams of the text) times inverse document frequency.
Weights are trained by follow-the-regularised-leader with an elastic-net penalty (L1 keeps them sparse), on a
bounded sample of labelled documents; a temperature, fitted on a part of the sample that training doesn't
see, calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, stage_table

#: Hashed features.
DIM = 1 << 15
#: The bound of the training sample: labelled documents for each language, and in all (with more than 64 languages each
#: gets a smaller, equal share; training holds 0.5 MB for each language).
SAMPLE_PER_LANGUAGE = 1000
SAMPLE_ROWS = 64_000
#: Steps of an octave in which the sample's share of a language is chosen.
LEVELS = 8
#: So many labels are broadcast to pick the sample; more are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 100_000
#: Follow-the-regularised-leader.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
EPOCHS, BATCH = 4, 32
#: One document in so many of the sample calibrates.
CALIBRATION_PART = 5
SCALE = 30.0
_GAP = re.compile(r"\s+")
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Hashed n-gram indexes of a text, all orders together."""
    s = _GAP.sub(" ", f" {text} ").lower()
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(49)
    one = (c + np.uint64(1)) * m
    two = (one[:-1] ^ (c[1:] + np.uint64(1 << 21))) * m
    three = (two[:-1] ^ (c[2:] + np.uint64(1 << 22))) * m
    return np.concatenate((one >> shift, two >> shift, three >> shift)).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key -> the sparse TF vector of the text (features, shares)."""
    for b in batches:
        idx, val = [], []
        for t in as_bytes(b.column(2)):
            f, n = np.unique(grams(t.decode("utf-8", "replace")), return_counts=True)
            idx.append(f)
            val.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["lang", "key", "idx", "val"])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(sample: pd.DataFrame) -> dict:
    """The model from rows (lang, key, idx, val): languages, weights (DIM x languages, idf and temperature included), bias."""
    sample = sample.sort_values(["key", "lang"]).reset_index(drop=True)
    languages = sorted(sample["lang"].unique())
    n, k = len(sample), len(languages)
    if not n:
        return {"languages": [], "weights": np.zeros((DIM, 0), np.float32), "bias": np.zeros(0, np.float32)}
    y = sample["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    df = np.bincount(np.concatenate(sample["idx"].to_list()), minlength=DIM)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    rows = [(i, SCALE * v * idf[i]) for i, v in zip(sample["idx"], sample["val"], strict=True)]
    held = np.arange(n) % CALIBRATION_PART == 0 if n >= 5 * CALIBRATION_PART else np.zeros(n, bool)
    train = np.flatnonzero(~held)
    z, s = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))  # the last row is the bias
    w = np.zeros((DIM + 1, k))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(train), max(1, len(train) // BATCH)):
            f = np.concatenate([np.append(rows[j][0], DIM) for j in part])
            x = np.concatenate([np.append(rows[j][1], 1.0) for j in part])
            at = np.repeat(np.arange(len(part)), [len(rows[j][0]) + 1 for j in part])
            seen, f = np.unique(f, return_inverse=True)
            # weights of the features in sight, in closed form
            ws = _lead(z[seen], s[seen])
            scores = np.zeros((len(part), k))
            np.add.at(scores, at, ws[f] * x[:, None])
            err = _softmax(scores)
            err[np.arange(len(part)), y[part]] -= 1
            g = np.zeros((len(seen), k))
            np.add.at(g, f, err[at] * x[:, None])
            g /= len(part)
            sigma = (np.sqrt(s[seen] + g * g) - np.sqrt(s[seen])) / ALPHA
            z[seen] += g - sigma * ws
            s[seen] += g * g
    w = _lead(z, s)
    scores = np.array([rows[j][1] @ w[rows[j][0]] + w[DIM] for j in np.flatnonzero(held)])
    t = _temperature(scores, y[held]) if held.any() else 1.0
    return {"languages": languages, "weights": (SCALE * w[:DIM] * idf[:, None] / t).astype(np.float32), "bias": (w[DIM] / t).astype(np.float32)}


def _lead(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a logarithmic grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def sample_of(docs: DataFrame, key: Column, text_col: str, lang_col: str, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The training sample (lang, key, text): of every language the distinct documents with a letter that come first by a
    hash of ``key`` and text, not above the bounds. Repeated rows count once.

    The hash's leading zeros give a level, and sketches of distinct hashes for each language and level (a few hundred
    numbers) tell down to which level a language's sample reaches; only those rows move."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key, F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    share = (F.col("key").cast("double") + 2.0**63) / 2.0**64
    labelled = labelled.withColumn("level", F.floor(-F.log2(F.greatest(share, F.lit(2.0**-60))) * LEVELS).cast("int"))
    levels = stage_table(labelled.groupBy("lang", "level").agg(F.approx_count_distinct("key", 0.02).alias("n")))
    quota = share_of(levels.select("lang").distinct().count(), per_language, rows)
    down = Window.partitionBy("lang").orderBy(F.desc("level"))
    levels = levels.withColumn("above", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the level that crosses the bound is the last to come in; fit cuts to the bound exactly
    cut = levels.filter(F.col("above") < quota).groupBy("lang").agg(F.min("level").alias("cut"))
    cut = stage_table(cut.select(F.col("lang").alias("_l"), "cut"))
    # texts stay where they are, whatever number of them has one language
    cut = F.broadcast(cut) if cut.count() <= MAX_BROADCAST_LANGUAGES else cut
    inside = labelled.join(cut, (F.col("lang") == F.col("_l")) & (F.col("level") >= F.col("cut"))).select("lang", "key", "text")
    return inside.dropDuplicates(["lang", "key"])


def share_of(languages: int, per_language: int, rows: int) -> int:
    """How many rows each language gives to the sample: equally many, and one at least, as no label is left out."""
    return max(1, min(per_language, rows // max(1, languages)))


def bounded(sample: pd.DataFrame, per_language: int, rows: int) -> pd.DataFrame:
    """The rows first by key: equally many of each language, not above the bounds."""
    most = share_of(sample["lang"].nunique(), per_language, rows)
    return sample.sort_values(["key", "lang"]).groupby("lang", sort=False).head(most)


def train(docs: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> dict:
    """Fits the model: vectors are made by the executors, the bounded sample of sparse vectors meets in one task, and
    the weights (DIM x languages) come back to the driver."""
    small_batches(docs.sparkSession)
    vectors = sample_of(docs, key, text_col, lang_col, per_language, rows).mapInArrow(_counts, "lang string, key bigint, idx array<int>, val array<float>")

    def fit_task(frames):
        found = list(frames)
        if not found:  # an empty sample: no model row
            return
        model = fit(bounded(pd.concat(found, ignore_index=True), per_language, rows))
        yield pd.DataFrame({"languages": [model["languages"]], "weights": [model["weights"].tobytes()], "bias": [model["bias"].tobytes()]})

    empty = docs.sparkSession.createDataFrame([], vectors.schema)
    row = empty.union(vectors).repartition(1).mapInPandas(fit_task, "languages array<string>, weights binary, bias binary").first()
    if row is None:
        return fit(pd.DataFrame({"lang": [], "key": [], "idx": [], "val": []}))
    k = len(row.languages)
    return {"languages": list(row.languages), "weights": np.frombuffer(row.weights, np.float32).reshape(DIM, k), "bias": np.frombuffer(row.bias, np.float32)}


def predict_text(text: str | None, model: dict) -> tuple[str, float]:
    """Language and probability of a whole text; und with score 0 for null, without letter, or without model."""
    if not has_letter(text) or not model["languages"]:
        return "und", 0.0
    f = grams(text)
    n = len(f)
    logits = np.zeros(len(model["languages"]))
    for i in range(0, n, 1 << 18):  # very long texts in parts
        logits += model["weights"][f[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
    p = _softmax((logits / n + model["bias"])[None])[0]
    best = int(p.argmax())
    return model["languages"][best], float(p[best])


def predict(docs: DataFrame, model: dict, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` (all columns) with lang_pred (string) and score (double, 0 to 1); own columns of these names are
    replaced. Null texts, texts without a letter, and all texts if nothing was learned: ``und``, 0."""
    small_batches(docs.sparkSession)
    docs = docs.drop(lang_pred, score)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = [predict_text(None if t is None else t.decode("utf-8", "replace"), m) for t in as_bytes(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names, lang_pred, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{lang_pred}` string, `{score}` double")


def op5_language_id(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.filter(~F.coalesce(held, F.lit(False))), F.col("doc_id"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
