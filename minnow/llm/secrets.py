"""Secret scans with DataFrame functions only (operator 9).

Three fixed patterns give the base spans. Candidate strings then get a sliding-window Shannon
entropy: the window's character counts are kept, one goes up for the character that enters and one
down for the character that leaves, and the sum of c * log2(c) follows these two counts. The greatest
window entropy is compared with the limit of the candidate's character class. Allow-listed candidates
are suppressed.

Defined cases: null counts as the empty text (no spans); a span covers the whole match; entropy
spans that overlap a base span are left out; of spans of one start the kinds follow in the order of
KINDS; a text of any length is scanned whole; repeated rows each get a result; an empty table gives
an empty result; other columns are ignored, and kept by redact(), whatever their names. Everything
happens within the row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate and the window over it.
CANDIDATE, WINDOW = "[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes, tried in turn, with the least window entropy (bits a character) of a secret.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.6), (".", 3.8))
#: What a candidate needs at least: a digit and a letter.
NEEDS = ("[0-9]", "[A-Za-z]")
#: Suppressed candidates: UUIDs, dates and times, slash- or dash-joined words, placeholders.
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "^(?:/?(?:[A-Za-z]+|[0-9]{1,4})[/_=-]+)+(?:[A-Za-z]+|[0-9]{1,4})?$",
    "(?i)example|placeholder|x{6}|0{8}|1234567890",
)
MASK = "[SECRET]"
#: Code of the character that stands for a count of 0.
ZERO = 48


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums(lengths: Column) -> Column:
    """Running totals of an array of numbers, in blocks of the square root of its size."""
    none = F.array().cast("array<long>")

    def running(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("t"), none.alias("out"))
        return F.aggregate(a, start, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["out"], F.array(s["t"] + x)).alias("out")), lambda s: s["out"])

    def blocks(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.greatest(F.size(a), F.lit(1)))).cast("int")
        firsts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, size)).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda i: running(F.slice(a, i + 1, size)))

    def joined_up(inner: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(inner, lambda b: F.element_at(b, -1))))
        return F.flatten(F.transform(F.arrays_zip(inner.alias("b"), F.slice(before, F.lit(1), F.size(inner)).alias("o")), lambda z: F.transform(z["b"], lambda x: x + z["o"])))

    return bound(lengths, lambda a: bound(blocks(a), joined_up))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, match, part>> of leftmost non-overlapping matches, in code points; part is the group's share of a match."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("gaps"))
    part = lambda m: F.regexp_extract(m, pattern, group) if group else m

    def placed(f: Column) -> Column:
        gaps = F.slice(f["gaps"], F.lit(1), F.size(f["whole"]))
        ends = sums(F.transform(F.arrays_zip(gaps.alias("g"), f["whole"].alias("m")), lambda z: (F.char_length(z["g"]) + F.char_length(z["m"])).cast("long")))
        rows = F.arrays_zip(ends.alias("end"), f["whole"].alias("match"))
        return F.transform(rows, lambda r: F.struct((r["end"] - F.char_length(r["match"])).alias("start"), r["end"].alias("end"), r["match"].alias("match"), part(r["match"]).alias("part")))

    return bound(found, placed)


NO_MATCHES = "array<struct<start:bigint,end:bigint,match:string,part:string>>"


def guarded(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast(NO_MATCHES))


def weight(c: Column) -> Column:
    """c * log2(c), 0 at 0."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, size: int = WINDOW) -> Column:
    """The greatest Shannon entropy of any window of size characters of an ASCII text (of the whole where it is shorter).

    The counts are a string with one place for each character, whose code there is ZERO and the count.
    """
    event = lambda code, up, full: F.struct(code.alias("code"), F.lit(up).alias("up"), full.alias("full"))

    def of(chars: Column) -> Column:
        n = F.least(F.size(chars), F.lit(size))
        fill = F.transform(F.slice(chars, 1, size), lambda x, i: event(F.ascii(x), 1, i == n - 1))
        later = F.when(F.size(chars) > size, F.sequence(F.lit(size), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
        moves = F.flatten(F.transform(later, lambda i: F.array(event(F.ascii(F.get(chars, i - size)), -1, F.lit(False)), event(F.ascii(F.get(chars, i)), 1, F.lit(True)))))

        def step(s: Column, e: Column) -> Column:
            c = F.ascii(F.substring(s["counts"], e["code"] + 1, F.lit(1))) - ZERO
            now = s["sum"] + weight(c + e["up"]) - weight(c)
            counts = F.overlay(s["counts"], F.char(c + e["up"] + ZERO), e["code"] + 1, F.lit(1))
            return F.struct(counts.alias("counts"), now.alias("sum"), F.when(e["full"], F.least(s["best"], now)).otherwise(s["best"]).alias("best"))

        start = F.struct(F.lit(chr(ZERO) * 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("best"))
        return F.aggregate(F.concat(fill, moves), start, step, lambda s: F.log2(n.cast("double")) - s["best"] / n)

    return bound(F.split(text, ""), of)


def outside(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no base span, in one walk over both in order."""
    kind = "struct<start:bigint,kind:int,end:bigint,text:string>"
    none = F.lit(None).cast(kind)
    held = lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        candidate = x["kind"] == len(KINDS) - 1
        hit = s["held"].isNotNull() & (x["start"] < s["held"]["end"])
        return F.struct(
            F.when(candidate, s["reach"]).otherwise(F.greatest(s["reach"], x["end"])).alias("reach"),
            F.when(candidate, F.when(x["start"] >= s["reach"], x).otherwise(none)).otherwise(F.when(hit, none).otherwise(s["held"])).alias("held"),
            F.when(candidate, held(s)).otherwise(s["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("reach"), none.alias("held"), F.array().cast(f"array<{kind}>").alias("out"))
    bare = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("string").alias("text")))
    return F.when(F.size(candidates) > 0, F.aggregate(F.array_sort(F.concat(bare, candidates)), start, step, held)).otherwise(F.array().cast(f"array<{kind}>"))


def scan(docs: DataFrame, *keep: str, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The columns of keep and __base, __all: arrays of struct<start, kind (index), end> by start, then kind."""
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    low = F.lower("__t")
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in ("passw", "secret", "token", "key")])
    df = df.select(
        "*",
        F.filter(guarded(named, matches(F.col("__t"), ASSIGN, 2)), lambda m: F.char_length(m["part"]) >= LEAST_ASSIGN).alias("__assign"),
        F.filter(guarded(F.contains("__t", F.lit("AKIA")), matches(F.col("__t"), ACCESS)), lambda m: F.char_length(m["match"]) >= LEAST_ACCESS).alias("__access"),
        # Runs are maximal, so a least length in the pattern drops exactly the short ones.
        guarded(F.col("__t").rlike(f"[0-9a-f]{{{LEAST_HEX}}}"), matches(F.col("__t"), f"[0-9a-f]{{{LEAST_HEX},}}")).alias("__hex"),
        guarded(F.col("__t").rlike(CANDIDATE[: CANDIDATE.index("{")] + f"{{{WINDOW}}}"), matches(F.col("__t"), CANDIDATE)).alias("__candidates"),
    )
    span = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))
    df = df.withColumn("__base", F.array_sort(F.concat(*(F.transform(f"__{kind}", span(k)) for k, kind in enumerate(KINDS[:3])))))

    def likely(m: Column) -> Column:
        return reduce(lambda a, b: a & b, [m["match"].rlike(x) for x in NEEDS] + [~m["match"].rlike(x) for x in allow])

    def secret(m: Column) -> Column:
        least = reduce(lambda rest, c: F.when(m["text"].rlike(c[0]), F.lit(c[1])).otherwise(rest), CLASSES[::-1], F.lit(99.0))
        return window_entropy(m["text"]) >= least

    asked = F.transform(F.filter("__candidates", likely), lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end"), m["match"].alias("text")))
    more = F.transform(F.filter(outside(F.col("__base"), asked), secret), span(3))
    return df.withColumn("__all", F.array_sort(F.concat("__base", more))).select(*keep, "__base", "__all")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of each row."""
    s = scan(docs, "doc_id")
    count = lambda k: F.size(F.filter("__all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return s.select("doc_id", *map(count, range(4)), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows of docs with every span of their text replaced by mask; n_chars, where docs has it, follows the text."""
    df = scan(docs, *docs.columns)
    text = F.col("text")
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("a"), zero.alias("end"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("cuts"))

    def closed(s: Column) -> Column:
        return F.when(s["a"] >= 0, F.concat(s["cuts"], F.array(F.struct(s["a"].alias("a"), s["end"].alias("b"))))).otherwise(s["cuts"])

    def merge(s: Column, x: Column) -> Column:
        """The last cut grows, or goes to the others when a span begins behind it."""
        new = x["start"] >= s["end"]
        return F.struct(F.when(new, x["start"]).otherwise(s["a"]).alias("a"), F.greatest(s["end"], x["end"]).alias("end"), F.when(new, closed(s)).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.aggregate("__all", start, merge, closed)
    df = df.withColumn("__cuts", cuts)
    kept = F.transform("__cuts", lambda c, i: F.concat(F.substring(text, F.when(i > 0, F.get("__cuts", i - 1)["b"]).otherwise(0).cast("int") + 1, (c["a"] - F.when(i > 0, F.get("__cuts", i - 1)["b"]).otherwise(0)).cast("int")), F.lit(mask)))
    tail = F.substring(text, F.element_at("__cuts", -1)["b"].cast("int") + 1, F.char_length(text))
    clean = F.when(F.size("__cuts") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(text)
    out = {"text": clean, "n_chars": F.when(F.size("__cuts") > 0, F.char_length(clean)).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return df.select(*(out[c].cast(docs.schema[c].dataType).alias(c) if c in out else F.col(c) for c in docs.columns))
