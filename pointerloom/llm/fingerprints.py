"""Document fingerprints by one-permutation MinHash, in SQL functions alone.

Each word shingle is hashed once; the top bits of the hash name a bin and the
least hash of a bin is kept. Empty bins are filled by optimal densification: each
bin has its own pseudo-random order of the bins and takes the first filled one.
The low byte of every bin is stored, and likeness is corrected for bytes that
agree by chance. All of it stays in the JVM.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointerloom.operators.skew import number_rows

BINS = 256
WORDS = 5
LOW_BITS = 8
# Bins are the top 8 bits of a signed hash, in its order.
BIN_SHIFT = 56
REST = (1 << BIN_SHIFT) - 1
PROBES = 8
WHITE = " \t\n\x0b\f\r"

# Every bin's order of the bins: from FIRST, in steps of an odd STEP, modulo BINS.
_rng = random.Random(20)
FIRST = [_rng.randrange(BINS) for _ in range(BINS)]
STEP = [2 * _rng.randrange(BINS // 2) + 1 for _ in range(BINS)]
BACK = [pow(s, -1, BINS) for s in STEP]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def shingle_hashes(text: Column) -> tuple[Column, Column]:
    """Words of a text, and from ``_words`` the 64-bit hashes of its five-word shingles.

    Fewer words are one shingle, no words none.
    """
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))
    words = F.split(trimmed, r"[ \t\n\x0B\f\r]+")
    last = F.greatest(F.size("_words") - WORDS, F.lit(0))
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("_words", i + 1, WORDS))
    )
    nothing = F.array().cast("array<long>")
    return (
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(words),
        F.when(F.size("_words") == 0, nothing).otherwise(hashes),
    )


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the packed low bytes of the bins of ``df[text]``, ``BINS`` bytes.

    Texts of equal words have equal fingerprints. A text without words, empty or
    null, has an empty one. Columns named here with an underscore are replaced.
    """
    names = [c for c in df.columns if c != out]
    words, hashes = shingle_hashes(F.col(text))
    ends = _longs([(b << BIN_SHIFT) | REST for b in range(-(BINS // 2), BINS // 2)])
    step = df.select(*names, words.alias("_words"))
    step = step.select(*names, hashes.alias("_hashes"))
    # With the last value of every bin mixed in, each bin has a first value.
    step = step.select(
        *names,
        (F.size("_hashes") > 0).alias("_any"),
        F.sort_array(F.concat("_hashes", ends)).alias("_sorted"),
    )
    bin_of = lambda x: F.shiftright(x, BIN_SHIFT)
    least = F.filter(
        "_sorted",
        lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("_sorted", i - 1))),
    )
    step = step.select(*names, "_any", least.alias("_least"))
    filled = F.transform(
        "_least",
        lambda x: F.when(x.bitwiseAND(F.lit(REST)) != REST, x.bitwiseAND(F.lit(255))),
    )
    step = step.select(*names, "_any", filled.alias("_bins"))
    places = F.filter(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get("_bins", j).isNotNull()
    )
    step = step.select(*names, "_any", "_bins", places.alias("_places"))

    def fill(x: Column, i: Column) -> Column:
        first, odd, back = (F.get(_longs(t), i) for t in (FIRST, STEP, BACK))
        probe = lambda t: F.get(
            "_bins", ((first + t * odd).bitwiseAND(F.lit(BINS - 1))).cast("int")
        )
        # The filled bin that comes first in this bin's order, from the list of them.
        turn = F.array_min(
            F.transform("_places", lambda j: ((j - first) * back).bitwiseAND(F.lit(BINS - 1)))
        )
        return F.coalesce(x, *[probe(F.lit(t)) for t in range(PROBES)], probe(turn))

    digits = F.array(*[F.lit(f"{v:02x}") for v in range(256)])
    dense = step.select(*names, "_any", F.transform("_bins", fill).alias("_dense"))
    packed = F.array_join(F.transform("_dense", lambda v: F.get(digits, v.cast("int"))), "")
    return dense.select(
        *names,
        F.when(F.col("_any"), F.unhex(packed)).otherwise(F.unhex(F.lit(""))).alias(out),
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1.

    Four bytes are compared at a time. Two empty ones are alike, an empty one is
    like no other; null if one is null.
    """
    low = 0x7F7F7F7F

    def differing(i: Column) -> Column:
        four = lambda x: F.conv(F.hex(F.substr(x, i * 4 + 1, F.lit(4))), 16, 10).cast("long")
        x = four(a).bitwiseXOR(four(b))
        spread = (x.bitwiseAND(F.lit(low)) + low).bitwiseOR(x)
        return F.bit_count(spread.bitwiseAND(F.lit(0x80808080))).cast("int")

    unlike = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS // 4 - 1)), F.lit(0), lambda s, i: s + differing(i)
    )
    chance = 1 / (1 << LOW_BITS)
    share = (1 - unlike / BINS - chance) / (1 - chance)
    size = F.octet_length(a) + F.octet_length(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None))
        .when(size == 0, F.lit(1.0))
        .when(size < 2 * BINS, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), share))
        .cast("double")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likeness to the next one's.

    Edited: the last third of the characters gives way to the first as many of
    the next document in descending ``doc_id``, after the last the first.

    Every row counts: texts are shuffled once, by a hash of id and text, so rows of
    one id and rows without id are spread; only the beginnings that edits need and
    the fingerprints travel again. Rows of one id go in the order of that hash, and
    null ids are the last. Equal rows are read once and returned as often as they
    occur: each but the last has its own text as the next one. Null texts are empty,
    a single document is its own next one, other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # No id has a blank, so the key tells ids and texts apart.
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "text")
    rows = rows.withColumn("key", F.md5(name.cast("binary")))
    # The numbering moves lengths only.
    lengths = (
        rows.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars"))
        .groupBy("key")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_chars").alias("n_chars"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    # Both uses below read the same two columns, hence the same shuffle.
    rows = rows.groupBy("key").agg(F.first("text").alias("text"))
    numbered = number_rows(lengths, ["doc_id", "key"])
    total = numbered.count()
    third = F.expr("n_chars div 3").alias("asked")
    # Descending: the next document has the number before, the first one the last.
    before = numbered.select(
        F.col("key").alias("asker"),
        "doc_id",
        third,
        F.pmod(F.col("idx") - 1, F.lit(max(total, 1))).alias("idx"),
    )
    asked = numbered.select("idx", "key").join(before, "idx").select(
        "key", "asker", "doc_id", "asked", F.lit(1).cast("long").alias("times")
    )
    again = numbered.where("copies > 1").select(
        "key", F.col("key").alias("asker"), "doc_id", third, (F.col("copies") - 1).alias("times")
    )
    printed = with_fingerprint(rows, "text", "fingerprint")
    given = printed.join(asked.unionByName(again), "key").select(
        F.col("asker").alias("key"),
        "doc_id",
        F.substring("text", F.lit(1), F.col("asked").cast("int")).alias("beginning"),
        F.col("fingerprint").alias("next_fingerprint"),
        "times",
    )
    n, third = F.char_length("text"), F.expr("char_length(text) div 3")
    edited = (
        printed.join(given, "key")
        .withColumn("n_chars", n.cast("long"))
        .withColumn(
            "edited",
            F.concat(F.substring("text", F.lit(1), n - third.cast("int")), "beginning"),
        )
        .drop("key", "text", "beginning")
    )
    both = with_fingerprint(edited, "edited", "edited_fingerprint")
    shown = both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "times",
    )
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return shown.select("*", repeated.alias("_time")).drop("times", "_time")
