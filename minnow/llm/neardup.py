"""Near-duplicates by improved consistent weighted sampling (operator 2).

Texts are multisets of five-word shingles with TF-IDF weights. Steps:

1. A count sketch of all shingles of all documents (bounded, broadcast) gives document frequencies.
2. Every text gets HASHES weighted samples; equal texts fall together by a 128-bit key of their words.
3. Samples are cut into bands. Within a bucket every pair of texts whose samples agree is compared,
   in the bucket of the first band they share, unless links found before already join the two: pairs
   are never rows, they arise and go within a task. Exact bounds (the weight of the shingles that no
   other text of the bucket has) drop most pairs that cannot reach the threshold; the rest is verified
   by weighted Jaccard similarity of the full multisets. Components of the links are classes.
4. A bucket over GROUP texts is dealt to parts. Each part is compared within itself, then one text
   for each class of a part with those of the other parts. What is still in another class than the
   bucket's main one and can reach the threshold there at all by the exact bound is then compared
   with every part, so that each pair of different classes has met.

The inverse document frequency is damped to [1, 1 + DAMP]: with an undamped one, the shared text of
a large group of copies weighs next to nothing and its members would no longer match.

Defined cases: texts without words are in no class but their own row's; a text of fewer than five
words is one shingle; a text of any length is taken whole; repeated rows are copies; null doc_ids
take part, and a class's id is its least non-null doc_id; an empty table gives an empty result; other
columns are ignored, whatever their names; ties of one class go to the least doc_id, then the least
text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minnow.llm import kernel as K
from minnow.llm.bits import Members
from minnow.llm.cluster import ship, stored
from minnow.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
#: Counters of the sketch; frequencies under FLOOR of the documents count as FLOOR, far over the sketch's noise.
SKETCH, PART, FLOOR, DAMP, LEVELS = 1 << 22, 1 << 16, 1e-3, 0.15, 16
#: Standard deviation of the agreeing samples of a pair at the threshold; how many must agree for a pair
#: to be verified: 4 deviations under the threshold.
SPREAD = (HASHES * THRESHOLD * (1 - THRESHOLD)) ** 0.5
AGREE = int(HASHES * THRESHOLD - 4 * SPREAD)
#: Texts of a part of a bucket and of a lot of parts that one call compares, and shingles of either.
GROUP, LOT, HELD = 2048, 2048, 4 << 20
#: Pairs of rows whose samples are compared at once.
PAIRS = 1 << 18
#: The band of rows that are compared whatever other bands they share.
ANY = -1
#: Columns of rows that meet in a part: whether a row is outside the bucket's main class, and the part where it is at home.
MEETING = {"lot": "int", "bucket": "long", "band": "int", "salt": "int", "parts": "int", "key": "binary", "root": "binary", "outside": "boolean", "home": "int", "size": "int", "bands": "array<bigint>", "marks": "binary"}
BLOCK = 1 << 19
SLOTS = 1 << 14


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, 32-bit shingle) of a block in order: rows, shingles, counts; and the 16-byte key of each row's words."""
    h, _, _, bounds = K.words(data, offsets, K.word_table())
    w, rows = K.windows(h, bounds, SHINGLE, short=True)
    tagged = np.sort(rows.astype(K.U64) << K.U64(32) | w >> K.U64(32))
    new = np.flatnonzero(np.concatenate([[True], tagged[1:] != tagged[:-1]])) if len(tagged) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(tagged)]]))
    return (tagged[new] >> K.U64(32)).astype(np.int64), (tagged[new] & K.U64(0xFFFFFFFF)).astype(np.uint32), counts, word_keys(h, bounds)


def word_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each row's sequence of words."""
    n = np.diff(bounds)
    place = K.ranges(n).astype(K.U64)
    return np.column_stack([K.mix(K.row_sums(K.mix(h ^ K.mix(place + K.U64(s))).view(np.int64), bounds).view(K.U64) + n.astype(K.U64)) for s in (1, 1 << 40)])


def sketched(columns: Iterable[pa.Array]) -> tuple[int, np.ndarray]:
    """Number of texts with words, and the sketch of their distinct shingles (uint32, for fewer than 2**32 texts)."""
    n, total = 0, np.zeros(SKETCH, np.uint32)
    for column in columns:
        for _, _, data, off in K.blocks(column, BLOCK):
            rows, shingle, _, _ = shingles(data, off)
            n += len(np.unique(rows))
            np.add.at(total, (shingle & np.uint32(SKETCH - 1)).astype(np.intp), np.uint32(1))  # in place, without a second sketch
    return n, total


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with words, and the sketch of their distinct shingles: int64 counters, summed in two steps."""
    spark = docs.sparkSession
    schema = "part int, salt int, counts binary"

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(x.sum()) % 16], pa.int32()), pa.array([z.compress(x.astype(np.int64).tobytes())], pa.binary())], ["part", "salt", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = sketched(batch.column(0) for batch in batches)
        if n:
            parts = total.reshape(-1, PART)
            yield from emit({i: x for i, x in enumerate(parts) if x.any()} | {-1: np.array([n])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(z.decompress(counts), np.int64)
                sums[part] = sums[part] + x if part in sums else x
        yield from emit(sums)

    sketches = docs.select("text").mapInArrow(count, schema)
    sketches = sketches.repartition("part", "salt").mapInArrow(add, schema).repartition("part").mapInArrow(add, schema)
    n, total, z = 0, np.zeros(SKETCH, np.int64), zstandard.ZstdDecompressor()
    for r in sketches.toLocalIterator():  # SKETCH / PART + 1 rows
        x = np.frombuffer(z.decompress(r["counts"]), np.int64)
        if r["part"] < 0:
            n = int(x[0])
        else:
            total[r["part"] * PART : (r["part"] + 1) * PART] = x
    return n, total


def levels(n: int, counts: np.ndarray) -> np.ndarray:
    """Damped inverse document frequency of each counter in LEVELS steps (uint8)."""
    share = np.clip(counts / max(n, 1), FLOOR, 1)
    return np.round((LEVELS - 1) * np.log(share) / np.log(FLOOR)).astype(np.uint8)


def idf(level: np.ndarray) -> np.ndarray:
    return 1 + DAMP * level / (LEVELS - 1)


@cache
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fixed random tables: r ~ Gamma(2, 1) and beta ~ U(0, 1) by slot, ln c with c ~ Gamma(2, 1), and one odd multiplier a hash."""
    g = np.random.Generator(np.random.PCG64(20240607))
    return g.gamma(2, 1, SLOTS), g.random(SLOTS), np.log(g.gamma(2, 1, 1 << 16)).astype(np.float32), g.integers(0, 1 << 63, HASHES, np.uint64) << K.U64(1) | K.U64(1)


@cache
def weight_tables(q: int) -> tuple[np.ndarray, np.ndarray]:
    """For weight 2**(q / 8): -r * (t - beta) - r + 1024 by slot, and t."""
    r, beta, _, _ = draws()
    t = np.floor(q / 8 * np.log(2) / r + beta)
    return (1024 - r * (t - beta) - r).astype(np.float32), t.astype(np.int64)


def samples(rows: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x HASHES sample values (0 for rows without shingles): the sampled shingle and its t, hashed."""
    out = np.zeros((n_rows, HASHES), K.U64)
    if not len(rows):
        return out
    _, _, ln_c, multipliers = draws()
    h = K.mix(shingle.astype(K.U64) + K.U64(1))
    used, q = np.unique(np.round(8 * np.log2(weight)).astype(np.int64), return_inverse=True)
    value = np.concatenate([weight_tables(int(x))[0] for x in used])
    t = np.concatenate([weight_tables(int(x))[1] for x in used])
    base = q * SLOTS
    full = np.unique(rows)
    firsts = np.searchsorted(rows, full)
    place = np.arange(len(rows)).astype(K.U64)
    for k in range(HASHES):
        x = h * multipliers[k]
        slot = (x >> K.U64(50)).astype(np.int64) + base
        ln_a = value[slot] + ln_c[(x >> K.U64(34)).astype(np.int64) & 0xFFFF]
        best = np.minimum.reduceat(ln_a.view(np.uint32).astype(K.U64) << K.U64(32) | place, firsts) & K.U64(0xFFFFFFFF)
        best = best.astype(np.int64)
        out[full, k] = K.mix(h[best] + t[slot[best]].astype(K.U64) * K.BASE)
    return out


def signatures(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """doc_id, hash (of doc_id and text), key (16 bytes, null for texts without words), size (shingles), bands (BANDS int64) and marks (a byte a sample) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for at, end, data, off in K.blocks(batch.column(2), BLOCK):
                n = end - at
                rows, shingle, counts, keys = shingles(data, off)
                s = samples(rows, shingle, counts * idf(level[shingle & np.uint32(SKETCH - 1)]), n)
                size = np.bincount(rows, counts, n).astype(np.int32)
                bands = np.zeros((n, BANDS), K.U64)
                for j in range(ROWS):
                    bands = K.mix(bands + s[:, j::ROWS])
                bands = K.mix(bands + np.arange(1, BANDS + 1).astype(K.U64) * K.BASE)
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(at, n) for c in batch.columns[:2]), pa.array([k.tobytes() if x else None for k, x in zip(keys, size, strict=True)], pa.binary()), pa.array(size),
                    pa.array([b.tolist() if x else None for b, x in zip(bands.view(np.int64), size, strict=True)], pa.list_(pa.int64())),
                    pa.array([m.tobytes() for m in (s >> K.U64(56)).astype(np.uint8)], pa.binary()),
                ], ["doc_id", "hash", "key", "size", "bands", "marks"])

    rest = [T.StructField("hash", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("marks", T.BinaryType())]
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *rest]))


def multisets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and shingles (sorted uint32 with repeats, as bytes) of the rows wanted (doc_id, hash); one row a key.

    Rows are first looked up in the bitmap of the hashes wanted, so that no text is shuffled or leaves the JVM in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, off in K.blocks(batch.column(2), BLOCK):
                rows, shingle, counts, keys = shingles(data, off)
                at_row = np.searchsorted(rows, np.arange(end - at + 1))
                have = np.flatnonzero(np.diff(at_row))
                sets = [np.repeat(shingle[at_row[i] : at_row[i + 1]], counts[at_row[i] : at_row[i + 1]]).tobytes() for i in have]
                ours = pa.array(have + at)
                yield pa.RecordBatch.from_arrays([*(c.take(ours) for c in batch.columns[:2]), pa.array([keys[i].tobytes() for i in have], pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "hash", "key", "shingles"])

    rows = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("doc_id", "text")).filter(Members(wanted, "hash").test(F.col("hash")))
    found = rows.select("doc_id", "hash", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("hash", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("shingles", T.BinaryType())]))
    on = (found["hash"] == wanted["hash"]) & found["doc_id"].eqNullSafe(wanted["doc_id"])
    return found.join(wanted, on, "left_semi").select("key", "shingles").dropDuplicates(["key"])


def in_lots(rows: DataFrame) -> DataFrame:
    """rows (bucket, salt, size ...) with lot: parts of buckets dealt to lots of some LOT rows or HELD shingles."""
    n, held = rows.agg(F.count("*"), F.sum("size")).first()
    lots = max(1, math.ceil(max((n or 0) / LOT, (held or 0) / HELD)))
    return rows.withColumn("lot", F.pmod(F.xxhash64("bucket", "salt"), F.lit(lots)).cast("int"))


def in_parts(member: DataFrame, seed: int) -> DataFrame:
    """member (bucket, band, key, size) of buckets of two texts or more, with parts and home: how many parts the bucket has and the one of this text."""
    counted = member.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("held")).filter("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / GROUP, F.col("held") / HELD)).cast("int")
    return member.join(counted.select("bucket", parts.alias("parts")), "bucket").withColumn("home", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("parts")).cast("int"))


def ordered(table: pa.Table) -> pa.Table:
    """Rows by part of a bucket, those outside the main class first, by key."""
    return table.sort_by([("bucket", "ascending"), ("salt", "ascending"), ("outside", "descending"), ("key", "ascending")]).combine_chunks()


def bounds_of(table: pa.Table) -> np.ndarray:
    """Where the parts of buckets begin in an ordered table, and its end."""
    bucket, salt = table.column("bucket").to_numpy(), table.column("salt").to_numpy()
    return np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(bucket)]])


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def comparisons(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of an ordered table: pairs of rows to be compared here, and how many of their samples agree.

    One of the two is outside the main class, they are in different classes, and this bucket is that of the first band
    they share; two outside rows, which may meet in several parts, are compared where the first of them is at home.
    """
    n = table.num_rows
    if n < 2:
        return
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(n, HASHES)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, BANDS)
    root, outside = codes(table.column("root")), table.column("outside").to_numpy(zero_copy_only=False)
    band, salt, home = (table.column(c).to_numpy() for c in ("band", "salt", "home"))
    bounds = bounds_of(table)
    counts = np.where(outside, np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n) - 1, 0)
    total = np.cumsum(counts)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(at, stop), counts[at:stop])
        j = i + 1 + K.ranges(counts[at:stop])
        at = stop
        agree = (marks[i] == marks[j]).sum(axis=1)
        here = np.flatnonzero((agree >= AGREE) & (root[i] != root[j]) & (~outside[j] | (home[i] == salt[i])))
        i, j, agree = i[here], j[here], agree[here]
        first = ((bands[i] == bands[j]).argmax(axis=1) == band[i]) | (band[i] == ANY)
        if first.any():
            yield i[first], j[first], agree[first]


def meeting(table: pa.Table) -> pa.Table:
    """The rows of a lot that are to be compared with another one of it; of buckets of several parts all rows."""
    table = ordered(table)
    used = table.column("parts").to_numpy() > 1
    for i, j, _ in comparisons(table):
        used[i] = used[j] = True
    return table.filter(pa.array(used))


def weighed_rows(table: pa.Table, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' multisets: row, shingle and weight of each distinct shingle in order."""
    sets = table.column("shingles").to_pylist()
    n = np.array([len(x) // 4 for x in sets], np.int64)
    flat = np.frombuffer(b"".join(sets), np.uint32)
    tag = np.repeat(np.arange(len(n)), n).astype(K.U64) << K.U64(32) | flat.astype(K.U64)
    new = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]])) if len(tag) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(tag)]]))
    shingle = flat[new]
    return (tag[new] >> K.U64(32)).astype(np.int64), shingle, counts * idf(level[shingle & np.uint32(SKETCH - 1)])


def alone(rows: np.ndarray, shingle: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the weight of its shingles that no other row of its group has."""
    _, back, n = np.unique(group[rows].astype(K.U64) << K.U64(32) | shingle.astype(K.U64), return_inverse=True, return_counts=True)
    return np.bincount(rows, weight * (n[back] == 1), len(group))


def jaccard(x: tuple[np.ndarray, np.ndarray, float], y: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard similarity of two weighed multisets: distinct shingles, their weights and the sum of these."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(x[1][i], y[1][j]).sum())
    return low / (x[2] + y[2] - low)


def linked(table: pa.Table, level: np.ndarray) -> pa.Table:
    """Links (a, b) of keys that join the classes of a lot, the likeliest pairs tried first; of buckets of several parts also
    (bucket, a, size): for each class of a part the text that agrees best with the class's most frequent samples."""
    table = ordered(table)
    rows, shingle, weight = weighed_rows(table, level)
    first = np.searchsorted(rows, np.arange(table.num_rows + 1))
    total = np.bincount(rows, weight, table.num_rows)
    bounds = bounds_of(table)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    most = total - alone(rows, shingle, weight, group)  # of a row's weight, what can be in common with another row
    key, keys, root = codes(table.column("key")), table.column("key").to_pylist(), codes(table.column("root"))
    parent = list(range(int(root.max()) + 1)) if len(root) else []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    class_of = dict(zip(key.tolist(), root.tolist(), strict=True))
    of = lambda i: (shingle[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], total[i])
    a, b = [], []
    for i, j, agree in comparisons(table):
        low = np.minimum(most[i], most[j])
        can = low >= THRESHOLD * (total[i] + total[j] - low) * (1 - 1e-9)
        i, j, agree = i[can], j[can], agree[can]
        for k in np.argsort(-agree, kind="stable"):
            x, y = find(class_of[key[i[k]]]), find(class_of[key[j[k]]])
            if x != y and jaccard(of(i[k]), of(j[k])) >= THRESHOLD:
                parent[x] = y
                a.append(keys[i[k]])
                b.append(keys[j[k]])
    leads = [r for g in np.flatnonzero(table.column("parts").to_numpy()[bounds[:-1]] > 1) for r in middles(table, range(bounds[g], bounds[g + 1]), [find(class_of[key[r]]) for r in range(bounds[g], bounds[g + 1])])] if len(keys) else []
    lead = table.take(pa.array(leads, pa.int64())).select(["bucket", "key", "size"])
    empty = lambda kind, n: pa.nulls(n, kind)
    return pa.table({
        "a": pa.chunked_array([pa.array(a, pa.binary()), *lead.column("key").chunks]), "b": pa.chunked_array([pa.array(b, pa.binary()), empty(pa.binary(), len(leads))]),
        **{c: pa.chunked_array([empty(kind, len(a)), *lead.column(c).chunks]) for c, kind in (("bucket", pa.int64()), ("size", pa.int32()))},
    })


def middles(table: pa.Table, rows: range, classes_: list[int]) -> list[int]:
    """For each class of these rows the row that agrees best with the most frequent samples."""
    marks = np.frombuffer(b"".join(table.column("marks").slice(rows.start, len(rows)).to_pylist()), np.uint8).reshape(len(rows), HASHES)
    label, out = np.array(classes_), []
    for c in np.unique(label):
        mine = np.flatnonzero(label == c)
        usual = np.array([np.bincount(marks[mine, k], minlength=256).argmax() for k in range(HASHES)], np.uint8)
        out.append(rows.start + int(mine[(marks[mine] == usual).sum(axis=1).argmax()]))
    return out


class Search:
    """The links of texts (key, doc_id, hash, size, bands, marks): keys of different texts whose similarity reaches the threshold."""

    def __init__(self, docs: DataFrame, texts: DataFrame, level: np.ndarray):
        self.docs, self.texts, self.level = docs, texts, docs.sparkSession.sparkContext.broadcast(level)
        self.signs = texts.select("key", "bands", "marks")
        self.sets: DataFrame | None = None

    def compared(self, rows: DataFrame) -> DataFrame:
        """Links and, for buckets of several parts, their leads among rows (bucket, band, salt, parts, key, root, outside, home, size)."""
        shared, schema = self.level, ", ".join(f"{k} {v}" for k, v in MEETING.items())
        met = stored(in_lots(rows).join(self.signs, "key").select(*MEETING).groupBy("lot").applyInArrow(meeting, schema))
        lacking = met.select("key").distinct()
        lacking = stored(lacking.join(self.sets, "key", "left_anti") if self.sets is not None else lacking)
        if self.sets is None or lacking.take(1):
            wanted = stored(self.texts.join(lacking, "key", "left_semi").select("doc_id", "hash"))
            more = stored(multisets(self.docs, wanted))
            self.sets = self.sets.unionByName(more) if self.sets is not None else more
        out = in_lots(met.drop("lot")).join(self.sets, "key").groupBy("lot").applyInArrow(lambda t: linked(t, shared.value), "a binary, b binary, bucket long, size int")
        return stored(out)

    def roots(self) -> DataFrame:
        """The components (node, root) of all links."""
        member = self.texts.select("key", "size", F.posexplode("bands").alias("band", "bucket"))
        everything = stored(in_parts(member, 0))
        rows, found, before = everything, None, None
        while True:
            out = self.compared(rows.withColumns({"salt": F.col("home"), "root": F.col("key"), "outside": F.lit(True)}))
            links = out.filter("b is not null").select("a", "b")
            found = links if found is None else found.union(links)
            leads = out.filter("b is null").select("bucket", F.lit(ANY).alias("band"), F.col("a").alias("key"), "size")
            n = leads.count()
            # Where the parts' classes no longer meet, another round over their leads would compare the same texts again.
            if not n or before is not None and n > before / 2:
                break
            before, rows = n, stored(in_parts(leads, n))
        roots = stored(components(found))
        large = everything.filter("parts > 1")
        return merged(roots, self.across(large, roots)) if before is not None else roots

    def across(self, large: DataFrame, roots: DataFrame) -> DataFrame:
        """Links (a, b) between classes of buckets that have several parts.

        A bucket's main class is the one with most texts in it. Its texts are each in one part (home); the others (outside)
        go to all parts, so that every pair of different classes meets in exactly one. Texts that share too little with the
        whole bucket to reach the threshold with any text of it are left out before, by an exact bound.
        """
        mine = stored(large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
        sizes = mine.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "root")).getField("root").alias("main")).filter("classes > 1").select("bucket", "main")
        rows = mine.join(mixed, "bucket").withColumn("outside", F.col("root") != F.col("main"))
        rows = stored(rows.join(self.hopeless(rows), ["bucket", "key"], "left_anti"))
        salts = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))
        out = self.compared(rows.withColumn("salt", F.explode(salts)).drop("main"))
        return out.filter("b is not null").select("a", "b")

    def hopeless(self, rows: DataFrame) -> DataFrame:
        """bucket and key of rows of whose weight more than 1 - THRESHOLD lies in shingles that no other text of the bucket has."""
        shared = self.level

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = pa.Table.from_batches([batch.slice(at, 64)])
                    row, shingle, weight = weighed_rows(part, shared.value)
                    whole = np.bincount(row, weight, part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column("bucket").combine_chunks().take(pa.array(row)), part.column("key").combine_chunks().take(pa.array(row)), pa.array(shingle.astype(np.int64)), pa.array(weight / whole[row])], ["bucket", "key", "shingle", "share"])

        each = rows.select("bucket", "key").join(self.sets, "key").select("bucket", "key", "shingles").mapInArrow(spread, "bucket long, key binary, shingle long, share double")
        single = each.groupBy("bucket", "shingle").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("share").alias("share")).filter("n = 1")
        return single.groupBy("bucket", "key").agg(F.sum("share").alias("share")).filter(F.col("share") > (1 - THRESHOLD) * (1 + 1e-9)).select("bucket", "key")


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (node, root) after further links (a, b): only the classes they touch are joined anew."""
    of = lambda c: F.coalesce("root", c)
    ends = more.join(roots, F.col("a") == F.col("node"), "left").select(of("a").alias("a"), "b")
    ends = ends.join(roots, F.col("b") == F.col("node"), "left").select("a", of("b").alias("b")).filter("a <> b")
    new = components(ends).withColumnsRenamed({"node": "old", "root": "new"})
    known = roots.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    single = new.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return stored(known.union(single))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of doc_id and text), key, root, class_size (rows) of each row, and best: null (is its id null?), doc_id and hash of the class's first row.

    Key, root and best are null for texts without words. Classes are settled over distinct texts; rows are joined once,
    by the key of their text.
    """
    ship(docs.sparkSession)
    n, counts = document_frequencies(docs)
    level = levels(n, counts)
    facts = stored(signatures(docs, level))
    wordy = facts.filter("key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    texts = stored(wordy.groupBy("key").agg(first, F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "bands", "marks"))))
    roots = Search(docs, texts.select("key", "first.doc_id", "first.hash", "size", "bands", "marks"), level).roots()
    of = texts.select("key", "first", "n").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    groups = of.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    of = stored(of.select("key", "root").join(groups, "root"))
    bare = facts.filter("key is null").select("doc_id", "hash", "key")
    rest = {"root": "binary", "class_size": "long", "best": of.schema["best"].dataType}
    bare = bare.select("*", *((F.lit(1) if c == "class_size" else F.lit(None)).cast(kind).alias(c) for c, kind in rest.items()))
    return wordy.select("doc_id", "hash", "key").join(of, "key").select("doc_id", "hash", "key", *rest).unionByName(bare)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of doc_id and text), key, root, class_id (least doc_id), class_size (rows) of each row; key and root are null for texts without words."""
    return judged(docs).select("doc_id", "hash", "key", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"), "class_size")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs with one row of each class, that of the least doc_id; texts without words all stay.

    Rows are known by doc_id and a hash of both. Those that may be on the list of rows that go, by the bitmap of its
    hashes, are joined with it; the other texts are joined with nothing. Of rows equal in both, one stays.
    """
    rows = judged(docs).filter("class_size > 1 and key is not null").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash")))
    found = rows.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "stays").agg(F.count("*").alias("n"))
    listed = stored(found.filter("not stays or n > 1").select("__id", "__hash", "stays"))
    may, at = Members(listed, "__hash").test(F.xxhash64("doc_id", "text")), lambda c: F.col(f"d.`{c}`")
    on = (F.xxhash64(at("doc_id"), at("text")) == F.col("l.__hash")) & at("doc_id").eqNullSafe(F.col("l.__id"))
    some = docs.filter(may).alias("d")
    kept = docs.filter(~may).unionByName(some.join(listed.alias("l"), on, "left_anti"))
    repeats = listed.filter("stays")
    if not repeats.take(1):
        return kept
    again = some.join(repeats.alias("l"), on, "left_semi").groupBy(at("doc_id").alias("__id"), F.xxhash64(at("doc_id"), at("text")).alias("__hash")).agg(F.first(F.struct(*map(at, docs.columns))).alias("__row"))
    return kept.unionByName(again.select("__row.*"))
