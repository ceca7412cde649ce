"""Byte-level BPE through sentencepiece (operator 8).

A sentencepiece BPE model is serialised straight from the rank file: every byte becomes one
character, every vocabulary entry a piece whose score is its negative rank, normalisation is the
identity. Texts are split by the pre-token pattern; each distinct pre-token is encoded once and
kept in a bounded memo, which a worker gives up at the end of a task. Decoding maps ids back to
their bytes.

Defined cases: null counts as the empty text (no ids); a text of any length is encoded whole; repeated
rows each get a result; null doc_ids are kept; other columns are ignored; an empty table gives an empty
result; of equal ranks the merge further left goes first. Special-token strings are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from minnow.llm import kernel as K
from minnow.llm.cluster import ship

#: First of the 256 characters that stand for bytes.
FIRST = 0x100
#: Distinct pre-tokens that a worker keeps, some 250 bytes each; 400,000 were no faster within a task.
MEMO = 50_000
#: Bytes of text that are encoded at once, unless a single text is longer.
BLOCK = 1 << 18


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised ModelProto: pieces in rank order, then the unknown piece."""
    # Field numbers and enum values fixed by sentencepiece_model.proto.
    pieces, trainer, normalizer = 1, 2, 3
    piece, score, kind, normal, unknown = 1, 2, 3, 1, 2
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chr(FIRST + b) for b in token).encode()
        out += field(pieces, field(piece, text) + field(score, -float(rank)) + field(kind, normal))
    out += field(pieces, field(piece, b"<unk>") + field(score, 0.0) + field(kind, unknown))
    model_type, bpe, vocab_size, unk_id, bos_id, eos_id, pad_id = 3, 2, 4, 40, 41, 42, 43
    minus = (1 << 64) - 1
    out += field(trainer, field(model_type, bpe) + field(vocab_size, len(ranks) + 1) + field(unk_id, len(ranks)) + field(bos_id, minus) + field(eos_id, minus) + field(pad_id, minus))
    name, add_dummy_prefix, remove_extra, escape = 1, 3, 4, 5
    out += field(normalizer, field(name, b"identity") + field(add_dummy_prefix, 0) + field(remove_extra, 0) + field(escape, 0))
    return bytes(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file, or from the file of public_tokenizers of that name."""
    with open(path if os.path.exists(path) else public_tokenizers.path(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes and decodes by a rank table and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.of_piece = np.array([r for _, r in sorted(ranks.items(), key=lambda x: x[1])] + [-1], np.int64)
        # All tokens' bytes in a row, and where those of each id begin and how many they are.
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            by_id[r] = t
        self.table = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.chars = {i: chr(FIRST + i) for i in range(256)}
        self.memo: dict[str, bytes] = {}

    def learn(self, tokens: list[str]) -> None:
        """Put pre-tokens' packed ids into the memo."""
        direct = [(t, self.ranks.get(t.encode())) for t in tokens]
        self.memo.update((t, struct.pack("<I", r)) for t, r in direct if r is not None)
        if rest := [t for t, r in direct if r is None]:
            mapped = [t.encode().decode("latin-1").translate(self.chars) for t in rest]
            for t, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
                self.memo[t] = self.of_piece[ids].astype("<u4").tobytes()

    def encode(self, texts: list[str], group: int = 64) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pre-tokens are learned by groups of texts."""
        out = []
        for at in range(0, len(texts), group):
            split = [self.split(x) for x in texts[at : at + group]]
            seen = set().union(*split)
            if len(self.memo) > MEMO and not seen <= self.memo.keys():
                self.memo.clear()
            if new := seen - self.memo.keys():
                self.learn(list(new))
            out += [b"".join(map(self.memo.__getitem__, tokens)) for tokens in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids, gathered from the table of all tokens."""
        at = np.frombuffer(ids, "<u4")
        n = self.lengths[at]
        return self.table[np.repeat(self.starts[at], n) + K.ranges(n)].tobytes()


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


#: Further columns of encode_documents().
KEPT = {"ids": (T.BinaryType(), pa.binary()), "decoded": (T.StringType(), pa.string())}


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, then those of ids (binary) and decoded (text) that keep names.

    path is the rank file's place on every worker, or the name of a file of public_tokenizers.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rows: dict[str, list] = {x: [] for x in ("n_tokens", "ids_sha256", "decoded_sha256", *keep)}
            for at, end, _, _ in K.blocks(batch.column(1), BLOCK):
                for ids in c.encode([x or "" for x in batch.column(1).slice(at, end - at).to_pylist()]):
                    back = c.decode(ids)
                    rows["n_tokens"].append(len(ids) // 4)
                    rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                    if "ids" in keep:
                        rows["ids"].append(ids)
                    if "decoded" in keep:
                        rows["decoded"].append(back.decode("utf-8", "replace"))
            kinds = {"n_tokens": pa.int64()} | {x: KEPT[x][1] for x in keep}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kinds.get(name, pa.string())) for name, x in rows.items())], ["doc_id", *rows])
        c.memo.clear()  # the worker lives on, for other stages too

    more = [T.StructField(x, KEPT[x][0]) for x in keep]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *more])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
