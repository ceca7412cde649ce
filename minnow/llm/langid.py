"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 6).

Counts come from every training text, summed by Spark per language and bucket; the matrix of log
probabilities (languages x buckets, both bounded) is broadcast, and texts are scored a batch at a
time in numpy.

Defined cases: null texts and texts without a letter are `und` with score 0; training skips rows
whose text or language is null; without any training row every prediction is `und`; ties go to the
language that sorts first; where there are more than MOST_LANGUAGES languages, those with most training
rows are learned (ties: the first by name), since the matrix is broadcast; a text of any length is read
whole; repeated rows each count and each get a result; an empty table gives an empty result; other
columns are ignored, and kept by recognised(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minnow.llm import kernel as K
from minnow.llm.cluster import ship

BUCKETS = 1 << 16
ORDERS = (2, 3)
SMOOTHING = 0.5
#: Languages of the matrix, which is broadcast (262 kB each).
MOST_LANGUAGES = 512
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """ASCII letters lower-cased, other ASCII a space, other bytes as they are."""
    t = np.full(256, 0x20, np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    t[0x61:0x7B] = t[0x41:0x5B] = range(0x61, 0x7B)
    return t


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket at every character (BUCKETS where none begins), and row bounds over characters."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[offsets]
    cp = np.frombuffer(letter_table()[data].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint32)
    out, key = [], cp * np.uint32(0x9E3779B1)
    for order in range(2, max(ORDERS) + 1):
        nxt = np.zeros(len(cp), np.uint32)
        nxt[: max(len(cp) - order + 1, 0)] = cp[order - 1 :]
        key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77) + nxt * np.uint32(0xC2B2AE3D)
        if order in ORDERS:
            bucket = ((key ^ (key >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1)
            for back in range(1, order):  # an n-gram does not run past its row
                past = bounds[1:] - back
                bucket[past[past >= bounds[:-1]]] = BUCKETS
            out.append(bucket)
    return out, bounds


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # languages x (BUCKETS + 1), the last column 0
    log_prior: np.ndarray


def train(docs: DataFrame, where: Column | None = None) -> LanguageModel:
    """Learn from text and lang of all rows that satisfy where."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows if where is None else rows.filter(where)
    usual = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    langs = sorted(r["lang"] for r in usual)
    rows = rows.filter(F.col("lang").isin(langs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for at, end, data, off in K.blocks(batch.column(1)):
                buckets, bounds = features(data, off)
                for lang in dict.fromkeys(langs[at:end]):
                    mine = langs[at:end] == lang
                    chars = np.repeat(mine, np.diff(bounds))
                    total = sums.setdefault(lang, np.zeros(BUCKETS + 2, np.int64))
                    for b in buckets:
                        total[: BUCKETS + 1] += np.bincount(b[chars], minlength=BUCKETS + 1)
                    total[-1] += mine.sum()
        for lang, total in sums.items():
            total[BUCKETS] = 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most MOST_LANGUAGES * (BUCKETS + 1) rows
    sums = np.zeros((len(langs), BUCKETS + 2))
    index = {x: i for i, x in enumerate(langs)}
    sums[[index[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    grams = sums[:, :BUCKETS] + SMOOTHING
    log_prob = np.zeros((len(langs), BUCKETS + 1), np.float32)
    log_prob[:, :BUCKETS] = np.log(grams / grams.sum(axis=1, keepdims=True))
    return LanguageModel(langs, log_prob, np.log(sums[:, -1] / max(sums[:, -1].sum(), 1)) if langs else np.zeros(0))


def score_block(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    n, k = len(offsets) - 1, len(model.languages)
    ascii_letters = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x7A) & ((data & 0xDF) >= 0x41) & ((data & 0xDF) <= 0x5A))])
    has = np.diff(ascii_letters[offsets]) > 0
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
        has[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    if not k:
        return [UNKNOWN] * n, np.zeros(n)
    buckets, bounds = features(data, offsets)
    total = np.tile(model.log_prior, (n, 1))
    for b in buckets:
        for j in range(k):
            total[:, j] += K.row_sums(model.log_prob[j][b].astype(np.float64), bounds)
    best = total.argmax(axis=1)
    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[j] if h else UNKNOWN for j, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score of each row, from its text alone."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, end, data, off in K.blocks(batch.column(0)):
                langs, score = score_block(model, data, off)
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).slice(at, end - at) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col("text").alias("__text"), *keep).mapInArrow(run, schema)


def recognised(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of docs whose text has a predicted language with at least this score."""
    spark = ship(docs.sparkSession)
    shared, text = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, end, data, off in K.blocks(batch.column(text)):
                langs, score = score_block(model, data, off)
                stays = np.array([x != UNKNOWN for x in langs], bool) & (score >= least)
                yield batch.slice(at, end - at).filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
