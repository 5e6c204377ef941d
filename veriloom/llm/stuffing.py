"""Pages of strung-together keywords, tags, product codes and links, by the mutual information of neighbouring words.

Corpus counts say for every pair of neighbouring words how often it stands so, and how often chance would bring it about.
Chance is the larger of two expectations: that of words drawn independently from the corpus, and that of the words around,
which is how often the same two stand near each other, two to ``NEAR`` words apart, in the texts that hold the pair. The
pointwise mutual information of a pair is the logarithm of count to chance. In sentences neighbours are neighbours far more
often than near each other; in word salad no more often than words drawn from the corpus, and in lists of a few keywords
(excessively repeated collocations) no more often than the same words a little apart. A word is strung if the mean over
the ``WINDOW`` pairs around it is under ``COHERENT`` bits, and a text is flagged if ``STRUNG`` of its words are. There are no word lists:
links, tags and codes count as one word each of their class.

Counts are exact, by key, with partial sums before the shuffle. Pairs so frequent that at most ``HOT`` of them can exist are
looked up where the text is read; the rest meet their texts in a join, in which no key has more than 1/``HOT`` of the pairs.

Edge cases: null and empty texts, and texts of fewer than ``LEAST_WORDS`` words, are never flagged; a pair seen once, of rare
words, speaks for nothing (it counts as coherent); words of languages without spaces are characters that share the weight
of what stands between spaces; repeated rows are each judged; an empty corpus gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.mojibake import repair
from veriloom.llm.unicode_forms import tidy
from veriloom.session import shared_path, table

#: Fewest words of a text that is judged.
LEAST_WORDS = 8
#: Words that are near each other, pairs that a window holds, count added to both sides of the ratio.
NEAR, WINDOW, SMOOTH = 6, 9, 0.05
#: Bits under which a window does not hold together, and the share of words in such windows that flags a text.
COHERENT, STRUNG = 3.5, 0.64
#: Pairs and words that can have more than 1/HOT of all counts: so many at most are broadcast.
HOT = 200_000
#: Words that are counted at once, few enough for a processor's cache; a longer text is counted by itself.
SLICE = 1 << 15

_TOKEN = regex.compile(r"https?://\S+|www\.\S+|#[\p{L}\p{M}\p{N}_]+|[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*")
_UNKNOWN = -128


@functools.lru_cache(maxsize=300_000)
def _of_chunk(chunk: str) -> str:
    """The words of what stands between spaces, each behind a space; links, tags and codes as their class, numbers left out."""
    out = []
    for w in _TOKEN.findall(chunk):
        if w.startswith(("http", "www.")) and ("://" in w or w[3] == "."):
            w = "\x01l"
        elif w[0] == "#":
            w = "\x01t"
        elif not w.isalpha() and any(c.isdigit() for c in w):
            if not any(c.isalpha() for c in w):
                continue
            w = "\x01c"
        out.append(" " + w)
    return "".join(out)


def words_of(text: str | None) -> tuple[str, bytes]:
    """(the words of a text with a space before each, for each word how many it shares its place between spaces with)."""
    if not text:
        return "", b""
    if not text.isascii():
        damaged, fixed = repair(text)
        text = tidy(fixed if damaged else text)
    parts = [p for chunk in text.lower().split() if (p := _of_chunk(chunk) if len(chunk) <= 80 else _of_chunk.__wrapped__(chunk))]
    words = "".join(parts)
    if words.count(" ") == len(parts):
        return words, b"\x01" * len(parts)
    return words, b"".join(bytes([min(n, 255)]) * n for n in (p.count(" ") for p in parts))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first position of every text and one past the last) of a column of words_of()."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(pc.utf8_ltrim_whitespace(words), " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in flat.dictionary.to_pylist()], np.uint64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64), ends


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE words."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def count_pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, first word, second word, times adjacent, times near in texts that hold it adjacent) of the words h of texts doc."""
    same = doc[:-1] == doc[1:]
    a, b, d = h[:-1][same], h[1:][same], doc[:-1][same].astype(np.uint64)
    pair = _mix(a, b)
    # near is the same in both orders: one sorted list of the pairs of each text, whichever word comes first
    unordered = lambda x, y, e: _mix(_mix(np.minimum(x, y), np.maximum(x, y)), e)
    own, place = np.unique(unordered(a, b, d), return_inverse=True)
    near = np.zeros(len(own), np.int64)
    for k in range(2, NEAR + 1):
        if len(h) <= k or not len(own):
            break
        ok = doc[:-k] == doc[k:]
        q = unordered(h[:-k][ok], h[k:][ok], doc[k:][ok].astype(np.uint64))
        at = np.minimum(np.searchsorted(own, q), len(own) - 1)
        near += np.bincount(at[own[at] == q], minlength=len(own))
    once = np.zeros(len(pair), np.int64)  # the near count of a text's pair, at the first of its places
    first = np.unique(_mix(pair, d), return_index=True)[1]
    once[first] = near[place[first]]
    keys, at, back = np.unique(pair, return_index=True, return_inverse=True)
    times = np.bincount(back, minlength=len(keys))
    return keys, a[at], b[at], times, np.bincount(back, weights=once, minlength=len(keys)).astype(np.int64)


def _counted(words: DataFrame) -> DataFrame:
    """(pair, w1, w2, adjacent, near): the counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ends = _hashes(batch.column("words"))
            parts = []
            for x, y in _slices(ends):
                doc = np.repeat(np.arange(y - x), np.diff(ends[x : y + 1]))
                parts.append(count_pairs(h[ends[x] : ends[y]], doc))
            if parts:
                keys, w1, w2, adjacent, near = (np.concatenate(c) for c in zip(*parts, strict=True))
                keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
                summed = [np.bincount(back, weights=c, minlength=len(keys)).astype(np.int64) for c in (adjacent, near)]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)) for g in (keys, w1[at], w2[at], *summed)], names=["pair", "w1", "w2", "adjacent", "near"])

    parts = words.select("words").where("n_words > 1").mapInArrow(run, "pair bigint, w1 bigint, w2 bigint, adjacent bigint, near bigint")
    return parts.groupBy("pair").agg(F.first("w1").alias("w1"), F.first("w2").alias("w2"), F.sum("adjacent").alias("adjacent"), F.sum("near").alias("near"))


def _joined(rows: DataFrame, key: str, counts: DataFrame, n: str, total: int) -> DataFrame:
    """rows with the count n of their key: frequent keys, HOT at most, by broadcast, the others in a join without large groups."""
    hot = F.broadcast(counts.where(F.col(n) * HOT >= total).withColumnRenamed(n, "__hot"))
    rare = counts.where(F.col(n) * HOT < total)
    rows = rows.join(hot, key, "left")
    found = rows.where("__hot is not null").withColumnRenamed("__hot", n)
    return found.unionByName(rows.where("__hot is null").drop("__hot").join(rare, key))


def _bits(pairs: DataFrame, total: int) -> DataFrame:
    """(pair, adjacent, q) with the mutual information in q: quarter bits, doubled, plus 1 where independent words are the chance."""
    first = pairs.groupBy("w1").agg(F.sum("adjacent").alias("n1"))
    second = pairs.groupBy("w2").agg(F.sum("adjacent").alias("n2"))
    known = _joined(_joined(pairs, "w1", first, "n1", total), "w2", second, "n2", total)
    apart = F.col("n1") * (F.col("n2") / F.lit(float(total)))
    around = F.col("near") / F.lit(float(2 * (NEAR - 1)))
    bits = F.log2((F.col("adjacent") + F.lit(SMOOTH)) / (F.greatest(apart, around) + F.lit(SMOOTH)))
    return known.select("pair", "adjacent", (F.round(F.greatest(F.least(bits, F.lit(15.0)), F.lit(-15.0)) * 4) * 2 + (apart > around).cast("int")).cast("int").alias("q"))


def verdict(q: np.ndarray, shared: np.ndarray) -> tuple[float, float, float]:
    """(mean bits, share of words in windows that do not hold together, the part of it where independent words are the chance)."""
    if not len(q):
        return 0.0, 0.0, 0.0
    bits, salad = (q >> 1) / 4.0, (q & 1).astype(float)
    ones = np.ones(min(WINDOW, len(q)))
    low = np.convolve(bits, ones, "same") / np.convolve(np.ones(len(q)), ones, "same") < COHERENT
    weight = 1.0 / shared
    weight = weight[:-1] + weight[1:]
    share = float((low * weight).sum() / weight.sum())
    return float(bits.mean()), share, float((low * weight * salad).sum() / weight.sum())


def stuffed(spark: SparkSession, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, mean_bits, strung_share, salad_share, stuffed) of every text; repeated keys are each judged."""
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for _, s in got], pa.int32()), pa.array([w for w, _ in got], pa.string()), pa.array([s for _, s in got], pa.binary())], names=["key", "n_words", "words", "shared"])

    path = shared_path(spark, "stuffing")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([rows.schema["key"], StructField("n_words", IntegerType()), StructField("words", StringType()), StructField("shared", BinaryType())])
    rows.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    _counted(words).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    total = int(counts.agg(F.sum("adjacent")).first()[0] or 0)
    if total:
        _bits(counts, total).write.parquet(f"{path}/bits")
        bits = spark.read.parquet(f"{path}/bits")
    else:
        bits = spark.createDataFrame([], "pair bigint, adjacent bigint, q int")
    frequent = bits.where(F.col("adjacent") * HOT >= F.lit(total)).select("pair", "q").toArrow()  # HOT at most
    order = np.argsort(hot := frequent.column("pair").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((hot[order], frequent.column("q").to_numpy().astype(np.int8)[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            h, ends = _hashes(batch.column("words"))
            found, missing, places = [], [], []
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                pair = _mix(h[x : y - 1], h[x + 1 : y]) if y - x > 1 else np.empty(0, np.uint64)
                q = np.full(len(pair), _UNKNOWN, np.int8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                    hit = known[at] == pair
                    q[hit] = values[at[hit]]
                rest = np.flatnonzero(q == _UNKNOWN)
                found.append(q.tobytes())
                missing.append(pair[rest].view(np.int64))
                places.append(rest)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "n_words", "shared", "row")], pa.array(found, pa.binary()), pa.array(missing, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["key", "n_words", "shared", "row", "q", "missing", "places"])

    fields = [rows.schema["key"], StructField("n_words", IntegerType()), StructField("shared", BinaryType()), StructField("row", LongType()), StructField("q", BinaryType())]
    schema = StructType(fields)
    schema = schema.add("missing", ArrayType(LongType())).add("places", ArrayType(IntegerType()))
    words.mapInArrow(look, schema).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    rare = texts.select("row", F.explode(F.arrays_zip("missing", "places")).alias("m")).select("row", F.col("m.missing").alias("pair"), F.col("m.places").alias("place"))
    rare = rare.join(bits.select("pair", F.col("q").alias("bits")), "pair").groupBy("row").agg(F.collect_list(F.struct("place", "bits")).alias("rest"))
    whole = texts.select("row", "key", "n_words", "shared", "q").join(rare, "row", "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_words").to_pylist()
            out = []
            for size, q, s, rest in zip(n, batch.column("q").to_pylist(), batch.column("shared").to_pylist(), batch.column("rest"), strict=True):
                values = np.frombuffer(q, np.int8).astype(np.int64)
                if rest.is_valid and len(rest):
                    values[rest.values.field("place").to_numpy()] = rest.values.field("bits").to_numpy()
                out.append(verdict(values, np.frombuffer(s, np.uint8)))
            cols = [np.array([o[k] for o in out], float) for k in range(3)]
            flagged = (np.array(n) >= LEAST_WORDS) & (cols[1] >= STRUNG)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), *map(pa.array, cols), pa.array(flagged, pa.bool_())], names=[key, "n_words", "mean_bits", "strung_share", "salad_share", "stuffed"])

    out = StructType([StructField(key, rows.schema["key"].dataType), StructField("n_words", IntegerType())])
    out = out.add("mean_bits", "double").add("strung_share", "double").add("salad_share", "double").add("stuffed", "boolean")
    return whole.drop("row").mapInArrow(judge, out)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_ids of pages of strung-together keywords, tags, product codes or links."""
    return stuffed(spark, table(spark, sf_dir, "documents"), "doc_id", "text").where("stuffed").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every document behind the verdict."""
    return stuffed(spark, table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each of the two expectations of mutual information decides: where most of the strung words are no likelier
    neighbours than independent words (word salad), or than words a little apart (repeated collocations)."""
    rule = F.when(F.col("salad_share") * 2 > F.col("strung_share"), "word salad").otherwise("repeated collocations")
    return p9_scores(spark, sf_dir).where("stuffed").groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rules": p9_rules}
