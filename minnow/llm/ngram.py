"""Language-model scoring by deleted interpolation (operator 3).

P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), with weights (l2, l1, l0) for each
bucket of the context's frequency. Counts come from all training texts; the weights are learned by
expectation-maximisation on a held-out part of the training texts against the counts of the rest.

Tokens never travel one by one. Texts are packed into chunks (a dictionary of 64-bit token hashes
and codes); a chunk asks for the counts of its distinct n-grams, as sorted hash lists cut by hash
range; a range adds up all lists and answers each chunk in the order of its list. A frequent token
is one entry of each chunk, so no key is hot, and all that moves is compressed.

Defined cases: a null text is the end token alone; repeated rows count and score each; null doc_ids
count like the empty id; with no training text only the uniform share is left; an empty table gives
an empty result; other columns are ignored; a text of any length is scored whole, and a worker holds
at least one at a time. Scores depend on counts alone, so ties cannot arise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minnow.llm import kernel as K
from minnow.llm.cluster import ship, stored

END, START = K.mix(np.array([1, 2], np.uint64))
#: Bytes of text in a chunk, and n-grams that one range adds up.
CHUNK, RANGE = 8 << 20, 2_000_000
#: Chunks that one task scores, some 70 MB with their counts.
TASK = 8
#: Roles of texts: counted and used to learn the weights against, held out for the weights, only scored.
COUNTED, WEIGHTS, SCORED = 0, 1, 2
BUCKETS = 32
F2_LEVELS, F1_LEVELS = 64, 128
ROUNDS = 60


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def chunk_rows(docs: DataFrame, fold: int, held: int, weights: int) -> DataFrame:
    """chunk, role, ids, lengths (tokens of each text), vocab (sorted hashes), codes."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        names = ["chunk", "role", "ids", "lengths", "vocab", "codes"]
        held_back: dict[int, list] = {r: [[], [], [], 0] for r in (COUNTED, WEIGHTS, SCORED)}

        def flush(role: int) -> pa.RecordBatch:
            nonlocal seq
            ids, lengths, hashes, _ = held_back[role]
            held_back[role] = [[], [], [], 0]
            n = np.concatenate(lengths)
            tokens = np.full(int(n.sum()), END, np.uint64)
            word = np.ones(len(tokens), bool)
            word[np.cumsum(n) - 1] = False
            tokens[word] = np.concatenate(hashes)
            vocab, codes = np.unique(tokens, return_inverse=True)
            seq += 1
            flat = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | seq], pa.int64()), pa.array([role], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                pa.array([pack(n.astype(np.uint32))], pa.binary()), pa.array([pack_sorted(vocab)], pa.binary()), pa.array([pack(codes.astype(np.uint32))], pa.binary()),
            ], names)

        for batch in batches:
            crc = K.crc_text(batch.column(0)) % fold
            roles = np.select([crc == held, crc == weights], [SCORED, WEIGHTS], COUNTED)
            for at, end, data, off in K.blocks(batch.column(1)):
                h, _, _, bounds = K.words(data, off, K.token_table(True))
                n = np.diff(bounds)
                for role, store in list(held_back.items()):
                    mine = np.flatnonzero(roles[at:end] == role)
                    if not len(mine):
                        continue
                    store[0].append(batch.column(0).slice(at, end - at).take(pa.array(mine)))
                    store[1].append(n[mine] + 1)
                    store[2].append(h[np.repeat(roles[at:end] == role, n)])
                    store[3] += int((off[1:] - off[:-1])[mine].sum())
                    if store[3] >= CHUNK:
                        yield flush(role)
        for role, store in list(held_back.items()):
            if store[0]:
                yield flush(role)

    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("role", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
        *(T.StructField(c, T.BinaryType()) for c in ("lengths", "vocab", "codes")),
    ])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bigrams(vocab: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it, and the code of that one (-1 at a text's start)."""
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = -1
    ahead = np.where(before < 0, START, vocab[before])
    return K.mix(ahead * K.BASE + vocab[codes]), before


def requests(chunks: DataFrame, bits: int) -> DataFrame:
    """grams (1 or 2), part (the top bits of the hashes), chunk, role, hashes, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocab, codes = unpack_sorted(row["vocab"]), unpack(row["codes"], np.uint32)
                two, many = np.unique(bigrams(vocab, codes, unpack(row["lengths"], np.uint32))[0], return_counts=True)
                for grams, hashes, counts in ((1, vocab, np.bincount(codes, minlength=len(vocab))), (2, two, many)):
                    part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                    cuts = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = [*cuts[1:], len(part)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([grams] * len(cuts), pa.int32()), pa.array(part[cuts]), pa.array([row["chunk"]] * len(cuts), pa.int64()), pa.array([row["role"]] * len(cuts), pa.int32()),
                        pa.array([pack_sorted(hashes[a:z]) for a, z in zip(cuts, ends, strict=True)], pa.binary()), pa.array([pack(counts[a:z].astype(np.uint32)) for a, z in zip(cuts, ends, strict=True)], pa.binary()),
                    ], ["grams", "part", "chunk", "role", "hashes", "counts"])

    return chunks.select("chunk", "role", "lengths", "vocab", "codes").mapInArrow(run, "grams int, part long, chunk long, role int, hashes binary, counts binary")


def answer(table: pa.Table) -> pa.Table:
    """Counts of one range: for each chunk over all training texts and over the counted ones, in its order; and totals (chunk -1)."""
    rows = table.to_pylist()
    lists = [unpack_sorted(r["hashes"]) for r in rows]
    counts = [unpack(r["counts"], np.uint32).astype(np.int64) for r in rows]
    sizes = [len(x) for x in lists]
    everything, back = np.unique(np.concatenate(lists), return_inverse=True)
    roles = np.repeat([r["role"] for r in rows], sizes)
    flat = np.concatenate(counts)
    counted = np.bincount(back, flat * (roles == COUNTED), len(everything)).astype(np.uint64)
    train = np.bincount(back, flat * (roles != SCORED), len(everything)).astype(np.uint64)
    cut = np.cumsum(sizes)[:-1]
    totals = np.array([train.sum(), (train > 0).sum(), counted.sum(), (counted > 0).sum()], np.uint64)
    places = np.split(back, cut)
    return pa.table({
        "chunk": pa.array([*(r["chunk"] for r in rows), -1], pa.int64()), "grams": pa.array([r["grams"] for r in rows] + [rows[0]["grams"]], pa.int32()), "part": pa.array([r["part"] for r in rows] + [rows[0]["part"]], pa.int64()),
        "train": pa.array([*(pack(train[p]) for p in places), pack(totals)], pa.binary()),
        "counted": pa.array([*(pack(counted[p]) if r["role"] == WEIGHTS else None for r, p in zip(rows, places, strict=True)), None], pa.binary()),
    })


@dataclass(frozen=True)
class Totals:
    """Tokens and distinct tokens, of all training texts and of the counted ones."""

    tokens: int
    distinct: int
    counted_tokens: int
    counted_distinct: int


def lookups(chunk: dict, answers: list[dict], which: str) -> tuple[np.ndarray, ...]:
    """For each token of a chunk: c(w), c(v w), c(v); and tokens of each text."""
    vocab, codes, lengths = unpack_sorted(chunk["vocab"]), unpack(chunk["codes"], np.uint32), unpack(chunk["lengths"], np.uint32).astype(np.int64)
    got = {g: np.concatenate([unpack(r[which], np.uint64) for r in sorted((r for r in answers if r["grams"] == g), key=lambda r: r["part"])]).astype(np.float64) for g in (1, 2)}
    two, before = bigrams(vocab, codes, lengths)
    _, back = np.unique(two, return_inverse=True)
    ends = got[1][np.searchsorted(vocab, END)]  # as many texts start as end
    return got[1][codes], got[2][back], np.where(before < 0, ends, got[1][before]), lengths


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def cells(totals: Totals):
    """Histogram of held-out tokens over (bucket, level of c(v w) / c(v), level of c(w) / N): bounded, whatever the input."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for chunk in left.to_pylist():
            one, two, context, _ = lookups(chunk, right.to_pylist(), "counted")
            f2 = np.where(two > 0, 1 + np.minimum(np.round(-4 * np.log(np.maximum(two, 1) / np.maximum(context, 1))), F2_LEVELS - 2), 0)
            f1 = np.where(one > 0, 1 + np.minimum(np.round(-4 * np.log(np.maximum(one, 1) / max(totals.counted_tokens, 1))), F1_LEVELS - 2), 0)
            key, n = np.unique((bucket(context) * F2_LEVELS + f2.astype(np.int64)) * F1_LEVELS + f1.astype(np.int64), return_counts=True)
        return pa.table({"cell": pa.array(key, pa.int64()), "n": pa.array(n.astype(np.int64), pa.int64())})

    return run


def learn_weights(cell: np.ndarray, n: np.ndarray, totals: Totals) -> np.ndarray:
    """BUCKETS x 3 weights (bigram, unigram, uniform) by expectation-maximisation, from one even pseudo-count each."""
    b, f2, f1 = cell // (F2_LEVELS * F1_LEVELS), cell // F1_LEVELS % F2_LEVELS, cell % F1_LEVELS
    p = np.column_stack([np.where(f2 > 0, np.exp((1 - f2) / 4), 0), np.where(f1 > 0, np.exp((1 - f1) / 4), 0), np.full(len(cell), 1 / (totals.counted_distinct + 1))])
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        share = weights[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.ones((BUCKETS, 3)) / 3
        np.add.at(sums, b, share)
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def scores(totals: Totals, weights: np.ndarray, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        out = []
        for i, chunk in enumerate(left.drop_columns(["ids"]).to_pylist()):
            one, two, context, lengths = lookups(chunk, answers, "train")
            w = weights[bucket(context)]
            p = w[:, 0] * np.where(context > 0, two / np.maximum(context, 1), 0) + w[:, 1] * one / max(totals.tokens, 1) + w[:, 2] / (totals.distinct + 1)
            base = np.log10((one + 0.1) / (totals.tokens + 0.1 * (totals.distinct + 1)))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            n = len(lengths)
            out.append(pa.table([
                left.column("ids").chunk(0).slice(i, 1).flatten() if left.column("ids").num_chunks == 1 else left.column("ids").combine_chunks().slice(i, 1).flatten(),
                pa.array([chunk["role"] == SCORED] * n), pa.array(lengths), pa.array(K.row_sums((one > 0).astype(np.int64), bounds)), pa.array([totals.tokens] * n, pa.int64()),
                pa.array(K.row_sums(base, bounds)), pa.array(K.row_sums(np.log10(p), bounds)),
            ], names))
        return pa.concat_tables(out)

    return run


def interpolated_scores(docs: DataFrame, fold: int = 10, held: int = 0, weights: int = 9) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Texts whose crc32(doc_id) mod fold is held are only scored; those where it is weights teach the mixture weights.
    """
    ship(docs.sparkSession)
    id_field = docs.schema["doc_id"]
    schema = T.StructType([
        id_field, T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    chunks = stored(chunk_rows(docs, fold, held, weights))
    # A token takes some 2 bytes of codes; the number only sets how finely the hashes are cut.
    size, n = chunks.agg(F.sum(F.octet_length("codes") + F.octet_length("vocab") / 4), F.count("*")).first()
    size, tasks = size or 0, max(math.ceil(n / TASK), 1)
    bits = max(0, int(np.ceil(np.log2(max(size / 2, 1) / RANGE))))
    answers = stored(requests(chunks, bits).repartition(max(tasks, 2 << bits), "grams", "part").groupBy("grams", "part").applyInArrow(answer, "chunk long, grams int, part long, train binary, counted binary"))
    sums = [unpack(r["train"], np.uint64).astype(np.int64) for r in answers.filter("chunk = -1 and grams = 1").select("train").toLocalIterator()]
    totals = Totals(*map(int, np.sum(sums, axis=0) if sums else np.zeros(4)))
    replies = answers.filter("chunk >= 0")
    dealt = chunks.repartition(tasks, "chunk")  # a task's share does not grow with the input
    counted = chunks.filter(F.col("role") == WEIGHTS).groupBy("chunk").cogroup(replies.filter("counted is not null").groupBy("chunk")).applyInArrow(cells(totals), "cell long, n long")
    cell = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    learned = learn_weights(cell.column("cell").to_numpy(), cell.column("n").to_numpy(), totals)
    return dealt.groupBy("chunk").cogroup(replies.select("chunk", "grams", "part", "train").repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(scores(totals, learned, schema.names), schema)
