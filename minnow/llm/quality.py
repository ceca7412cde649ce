"""Quality rules: compression bands beside the plain word counts (operator 7).

zstandard ratios (raw bytes / compressed bytes) of the whole text and of fixed chunks must lie
within bands that depend on the length; text that compresses too well repeats itself, text that
hardly compresses is noise.

Defined cases: a null text counts as empty; texts without words fail the base rule; a text of any
length is compressed whole; ratios equal to a limit are inside, a share of chunks equal to the limit is
outside; repeated rows each get their own result; null doc_ids are kept; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from minnow.llm import kernel as K
from minnow.llm.cluster import ship

#: Least bytes, then least and greatest ratio allowed for texts from that length on.
BANDS = ((0, 0.0, 3.0), (256, 1.15, 4.0), (1024, 1.3, 5.0), (4096, 1.4, 6.0), (16384, 1.45, 7.0), (65536, 1.5, 8.0))
CHUNK = 4096
#: Ratios allowed for chunks, and the share of chunks outside, under and over together, from which on a text is rejected.
CHUNK_BAND, CHUNK_SHARE = (1.35, 6.0), 0.25
LEVEL = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of each row of a block, and its word starts and ends for other statistics."""
    h, starts, ends, bounds = K.words(data, offsets, K.token_table(False))
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[ends] - lead[starts]
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[data], out=marks[1:])
    return {
        "n_words": np.diff(bounds),
        "word_chars": K.row_sums(chars, bounds),
        "n_symbols": marks[offsets[1:]] - marks[offsets[:-1]],
        "n_dup_lines": dup_lines(data, offsets, starts),
        "n_repeat_words": repeat_words(h, bounds),
        "_words": (h, starts, ends, bounds),
    }


def dup_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    norm = np.where(data == 0, np.uint8(0xFF), data)
    norm = np.where(data == 10, np.uint8(0), norm)
    starts, ends, bounds = K.spans(norm != 0, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    _, later = K.repeated(K.run_hashes(norm, starts, ends), rows)
    wordy = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    return K.row_sums((later & wordy).astype(np.int64), bounds)


def repeat_words(h: np.ndarray, bounds: np.ndarray, k: int = 8) -> np.ndarray:
    w, rows = K.windows(h, bounds, k, short=False)
    many, _ = K.repeated(w, rows)
    first = bounds[:-1][rows] + K.ranges(np.maximum(np.diff(bounds) - k + 1, 0))
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, first[many], 1)
    np.subtract.at(cover, first[many] + k, 1)
    return K.row_sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), bounds)


def band(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for least, lo, hi in reversed(BANDS) if n_bytes >= least)


def ratios(text: memoryview, z: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Whole ratio, and shares of chunks that lie under and over the chunk band; a rest after full chunks counts as the last CHUNK bytes."""
    n = len(text)
    if not n:
        return 0.0, 0.0, 0.0
    whole = n / len(z.compress(text))
    under = over = full = 0
    starts = [*range(0, n - CHUNK + 1, CHUNK), *([n - CHUNK] if n > CHUNK and n % CHUNK else [])]
    for at in starts:
        r = CHUNK / len(z.compress(text[at : at + CHUNK]))
        full += 1
        under += r < CHUNK_BAND[0]
        over += r > CHUNK_BAND[1]
    return whole, under / max(full, 1), over / max(full, 1)


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for at, end, data, off in K.blocks(batch.column(1)):
            c = base_counts(data, off)
            raw = memoryview(np.ascontiguousarray(data))
            r = np.array([ratios(raw[off[i] : off[i + 1]], z) for i in range(end - at)]).reshape(-1, 3)
            limits = np.array([band(int(n)) for n in np.diff(off)]).reshape(-1, 2)
            failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
            inside = (r[:, 0] >= limits[:, 0]) & (r[:, 0] <= limits[:, 1]) & (r[:, 1] + r[:, 2] < CHUNK_SHARE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, end - at), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(inside & ~failed), *(pa.array(r[:, i]) for i in range(3))],
                ["doc_id", *COUNTS, "base_failed", "kept", "ratio", "chunks_under", "chunks_over"],
            )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a document: counts, ratios, base_failed and the verdict kept."""
    ship(docs.sparkSession)
    schema = T.StructType([
        docs.schema["doc_id"],
        *(T.StructField(k, T.LongType()) for k in COUNTS),
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
        *(T.StructField(k, T.DoubleType()) for k in ("ratio", "chunks_under", "chunks_over")),
    ])
    return docs.select("doc_id", "text").mapInArrow(judge, schema)
