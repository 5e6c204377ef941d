"""Identities matched with a knowledge base: embeddings, nearest neighbours, clusters of similar names."""

from __future__ import annotations

import difflib
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: Dimensions of the default embedding; thresholds for brands, roles and for names of up to three characters.
DIMENSIONS, BRAND, ROLE, SHORT = 256, 0.95, 0.90, 0.99
#: Most bytes of vectors that are sent to every executor; beyond it the neighbours are searched block by block in a join.
BROADCAST_BYTES = 64 << 20
#: Vectors of a block in that join.
BLOCK = 8192


def hashed_ngrams(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """Unit vector of the hashed 2- to 4-grams of a name in small letters; all zero for an empty one."""
    v = np.zeros(dimensions, np.float32)
    t = f"^{' '.join((text or '').lower().split())}$"
    if len(t) > 2:
        for n in (2, 3, 4):
            for k in range(len(t) - n + 1):
                h = zlib.crc32(t[k : k + n].encode())
                v[h % dimensions] += 1.0 if h >> 31 else -1.0
    length = float(np.linalg.norm(v))
    return (v / length if length else v).tolist()


@F.pandas_udf(ArrayType(FloatType()))
def embed(s: pd.Series) -> pd.Series:
    """The default embedder; any function from names to unit vectors can take its place."""
    return s.map(hashed_ngrams)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _best(q: np.ndarray, ids: list, matrix: np.ndarray, own: list, k: int, exclude_self: bool) -> list[list[tuple]]:
    """For each query the k (id, score) of largest inner product, ties by id."""
    scores = q @ matrix.T
    out = []
    for row, me in zip(scores, own, strict=True):
        take = min(len(ids), k + 1 + 8)
        near = np.argpartition(-row, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
        edge = row[near].min()
        near = np.flatnonzero(row >= edge) if take < len(ids) else near
        order = sorted(((-row[j], ids[j]) for j in near if not (exclude_self and ids[j] == me)), key=lambda t: (round(t[0], 9), t[1]))
        out.append([(i, -s) for s, i in order[:k]])
    return out


def _merged(found: DataFrame, k: int, names: list[str]) -> DataFrame:
    """The k best of each query from the k best of each block."""
    pack = F.struct((-F.col("score")).alias("s"), F.col("_b").alias("b"))
    merged = found.groupBy("_q").agg(F.slice(F.array_sort(F.collect_list(pack)), 1, k).alias("best")).select("_q", F.posexplode("best").alias("r", "x"))
    return merged.select("_q", F.col("x.b").alias("_b"), (-F.col("x.s")).alias("score"), (F.col("r") + 1).cast("int").alias("rank")).toDF(*names, "score", "rank")


def nearest(queries: DataFrame, query_id: str, query_vec: str, base: DataFrame, base_id: str, base_vec: str, k: int = 1, exclude_self: bool = False) -> DataFrame:
    """(query_id, base_id, score, rank): the k base vectors of largest inner product for every query; ties by base_id.

    The base is a stated set that every query is compared with, in blocks: as one broadcast matrix while its size is within
    BROADCAST_BYTES, else as blocks that each meet all queries, with the k best of each block merged by aggregation.
    """
    count, width = base.where(F.col(base_vec).isNotNull()).agg(F.count(F.lit(1)), F.max(F.size(base_vec))).first()
    schema = StructType([queries.schema[query_id], base.schema[base_id], StructField("score", DoubleType()), StructField("rank", IntegerType())])
    names = [query_id, base_id]
    renamed = queries.select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_v")).where("_v is not null")
    out_schema = StructType([StructField("_q", queries.schema[query_id].dataType), StructField("_b", base.schema[base_id].dataType), StructField("score", DoubleType()), StructField("rank", IntegerType())])
    if not count:
        return queries.sparkSession.createDataFrame([], schema)

    if count * (width or 1) * 8 <= BROADCAST_BYTES:
        rows = base.where(F.col(base_vec).isNotNull()).select(base_id, base_vec).orderBy(base_id).collect()
        arrow = to_arrow_schema(out_schema)
        shared = queries.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                own = batch.column("_q").to_pylist()
                if not own:
                    continue
                got = _best(np.array(batch.column("_v").to_pylist(), np.float64), ids, matrix, own, k, exclude_self)
                flat = [(me, i, float(s), r) for me, hits in zip(own, got, strict=True) for r, (i, s) in enumerate(hits, 1)]
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True)) for row in flat], schema=arrow)

        return renamed.mapInArrow(run, out_schema).toDF(*names, "score", "rank")
    asked, spread = _in_blocks(renamed, base.where(F.col(base_vec).isNotNull()).select(F.col(base_id).alias("_b"), F.col(base_vec).alias("_w")), int(count))

    def block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["_q", "_b", "score", "rank"])
        right = right.sort_values("_b")
        got = _best(np.array(left["_v"].tolist(), np.float64), right["_b"].tolist(), np.array(right["_w"].tolist(), np.float64), left["_q"].tolist(), k, exclude_self)
        return pd.DataFrame([(me, i, float(s), r) for me, hits in zip(left["_q"], got, strict=True) for r, (i, s) in enumerate(hits, 1)], columns=["_q", "_b", "score", "rank"])

    found = asked.groupBy("_block", "_part").cogroup(spread.groupBy("_block", "_part")).applyInPandas(block, out_schema)
    return _merged(found, k, names)


#: Vectors an index is fitted on at most, and the most cells it has.
INDEX_SAMPLE, MOST_CELLS = 20_000, 1024


def fit_cells(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of a sample of vectors, by spherical k-means begun with vectors that are far from each other."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rnd = np.random.default_rng(seed)
    chosen = [int(rnd.integers(len(unit)))]
    closest = unit @ unit[chosen[0]]
    while len(chosen) < min(cells, len(unit)):
        weight = np.maximum(1 - closest, 0) ** 2
        total = weight.sum()
        if total < 1e-12:
            break  # no more different vectors
        chosen.append(int(rnd.choice(len(unit), p=weight / total)))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
    centre = unit[chosen]
    for _ in range(rounds):
        own = (unit @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centre)
    return centre


def probes_for(vectors: np.ndarray, centre: np.ndarray, k: int, target: float, most: int = 500) -> int:
    """So many cells closest to a vector hold that share of its k nearest neighbours among the vectors, for ``most`` of them."""
    order = np.argsort(-(vectors[:most] @ centre.T), axis=1, kind="stable")
    own = (vectors @ centre.T).argmax(axis=1)
    scores = vectors[:most] @ vectors.T
    scores[np.arange(len(scores)), np.arange(len(scores))] = -np.inf
    if scores.shape[1] < 2:
        return 1
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, scores.shape[1] - 1)]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    return int(np.quantile(np.take_along_axis(rank, own[near], axis=1), target, method="higher")) + 1


def nearest_by_cells(queries: DataFrame, query_id: str, query_vec: str, base: DataFrame, base_id: str, base_vec: str, k: int = 1, exclude_self: bool = False, cells: int | None = None, probes: int | None = None, sample: int = INDEX_SAMPLE, target: float = 0.95) -> DataFrame:
    """(query_id, base_id, score, rank) as nearest(), from the cells closest to each query only: an approximate index.

    Cells are fitted on ``sample`` vectors at most, those of the smallest hashes of their id; every base vector is in the
    cell of its nearest centroid. By default there are as many cells as the square root of the base, MOST_CELLS at most,
    and so many are probed as find ``target`` of the neighbours within the sample. What share of the exact result that
    finds in the whole base is for recall() to say; vectors without clusters need most cells. A cell, and the
    queries that probe it, are split by hash into parts of at most about BLOCK, so a cell that holds most vectors is in no one task.
    """
    rows = base.where(F.col(base_vec).isNotNull()).select(F.col(base_id).alias("_b"), F.col(base_vec).alias("_w"))
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_v")).where("_v is not null")
    schema = StructType([StructField("_q", queries.schema[query_id].dataType), StructField("_b", base.schema[base_id].dataType), StructField("score", DoubleType()), StructField("rank", IntegerType())])
    count = rows.count()
    if not count:
        return queries.sparkSession.createDataFrame([], schema).toDF(query_id, base_id, "score", "rank")
    h = F.xxhash64(F.lit("cells"), "_b")
    some = rows if count <= sample else rows.where(h < int(-(2**63) + 2**64 * min(1.0, 1.15 * sample / count)))
    fitted = [r[1] for r in sorted(some.select(h.alias("h"), "_w").limit(2 * sample).collect(), key=lambda r: r[0])[:sample]]
    centre = fit_cells(np.array(fitted, np.float64), min(MOST_CELLS, max(1, cells or round(count**0.5))))
    near = min(len(centre), probes or probes_for(np.array(fitted, np.float64), centre, k, target))

    def cell_of(vectors: pd.Series, n: int) -> list[list[int]]:
        scores = np.array(vectors.tolist(), np.float64) @ centre.T
        return np.argsort(-scores, axis=1, kind="stable")[:, :n].tolist()

    @F.pandas_udf(IntegerType())
    def own_cell(v: pd.Series) -> pd.Series:
        return pd.Series([c[0] for c in cell_of(v, 1)] if len(v) else [], dtype="int32")

    @F.pandas_udf(ArrayType(IntegerType()))
    def probed(v: pd.Series) -> pd.Series:
        return pd.Series([np.array(c, np.int32) for c in cell_of(v, near)] if len(v) else [], dtype=object)

    stored = rows.withColumn("_cell", own_cell("_w"))
    probing = asked.withColumn("_cell", F.explode(probed("_v")))
    held = {r[0]: r[1] for r in stored.groupBy("_cell").count().collect()}  # MOST_CELLS rows at most
    tried = {r[0]: r[1] for r in probing.groupBy("_cell").count().collect()}
    parts = lambda n: F.element_at(F.create_map(*[x for c, m in n.items() for x in (F.lit(c), F.lit(-(-m // BLOCK)))]), F.col("_cell"))
    if not tried:
        return queries.sparkSession.createDataFrame([], schema).toDF(query_id, base_id, "score", "rank")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    part_of = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    stored = stored.withColumn("_block", part_of("_b", parts(held))).withColumn("_part", all_of(parts(tried)))
    probing = probing.withColumn("_part", part_of("_q", parts(tried))).withColumn("_block", all_of(parts(held)))

    def block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        flat = []
        if len(left) and len(right):
            right = right.sort_values("_b")
            got = _best(np.array(left["_v"].tolist(), np.float64), right["_b"].tolist(), np.array(right["_w"].tolist(), np.float64), left["_q"].tolist(), k, exclude_self)
            flat = [(me, i, float(s), r) for me, hits in zip(left["_q"], got, strict=True) for r, (i, s) in enumerate(hits, 1)]
        out = pd.DataFrame(flat, columns=["_q", "_b", "score", "rank"])
        return out.astype({"_q": left["_q"].dtype, "_b": right["_b"].dtype, "score": "float64", "rank": "int32"})

    group = ["_cell", "_block", "_part"]
    found = probing.groupBy(*group).cogroup(stored.groupBy(*group)).applyInPandas(block, schema)
    return _merged(found, k, [query_id, base_id])


def recall(found: DataFrame, exact: DataFrame, query_id: str, base_id: str) -> DataFrame:
    """(exact, found, recall): how many of the exact neighbours are among those found."""
    hits = exact.select(query_id, base_id).join(found.select(query_id, base_id).distinct().withColumn("hit", F.lit(1)), [query_id, base_id], "left")
    return hits.agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found")).withColumn("recall", F.when(F.col("exact") > 0, F.col("found") / F.col("exact")))


def _in_blocks(asked: DataFrame, base: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Queries (_q, _v) and base (_b, _w) of count rows with _block and _part: neither side is ever whole in one task, blocks
    of the base meet parts of the queries."""
    blocks, parts = max(1, -(-count // BLOCK)), max(1, -(-asked.count() // BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = base.withColumn("_block", F.pmod(F.xxhash64("_b"), F.lit(blocks)).cast("int")).withColumn("_part", numbers(parts))
    return asked.withColumn("_part", F.pmod(F.xxhash64("_q"), F.lit(parts)).cast("int")).withColumn("_block", numbers(blocks)), spread


def count_near(queries: DataFrame, query_id: str, query_vec: str, base: DataFrame, base_id: str, base_vec: str, threshold: float, exclude_self: bool = False) -> DataFrame:
    """(query_id, near): how many base vectors have an inner product of the threshold at least, for every query that has any.

    All of them count, block by block; no list of the nearest stands between.
    """
    rows = base.where(F.col(base_vec).isNotNull()).select(F.col(base_id).alias("_b"), F.col(base_vec).alias("_w"))
    asked, spread = _in_blocks(queries.select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_v")).where("_v is not null"), rows, rows.count())

    def block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["_q", "near"])
        hit = np.array(left["_v"].tolist(), np.float64) @ np.array(right["_w"].tolist(), np.float64).T >= threshold
        if exclude_self:
            hit &= left["_q"].to_numpy()[:, None] != right["_b"].to_numpy()[None, :]
        return pd.DataFrame({"_q": left["_q"], "near": hit.sum(axis=1)})

    schema = StructType([StructField("_q", queries.schema[query_id].dataType), StructField("near", LongType())])
    found = asked.groupBy("_block", "_part").cogroup(spread.groupBy("_block", "_part")).applyInPandas(block, schema)
    return found.groupBy("_q").agg(F.sum("near").alias("near")).where("near > 0").toDF(query_id, "near")


def match_names(names: DataFrame, name: str, kb: DataFrame, tag: str, threshold: float = BRAND, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """(name, tag, score) of each distinct name whose nearest entry is near enough; names of up to 3 characters need more."""
    asked = names.select(F.col(name).alias("name")).where("name is not null and name != ''").distinct().withColumn("vec", embedder(F.lower("name")))
    base = kb.select(F.col(tag).alias("tag")).distinct().withColumn("vec", embedder(F.lower("tag")))
    limit = F.when(F.length("name") <= 3, F.lit(SHORT)).otherwise(F.lit(threshold))
    return nearest(asked, "name", "vec", base, "tag", "vec").where(F.col("score") >= limit).select("name", "tag", "score")


def official_domains(messages: DataFrame, key: str, identities: str, kb: DataFrame, threshold: float = BRAND) -> DataFrame:
    """(key, brands, official) of messages with a matched identity: the brands they claim and all their domains."""
    said = messages.select(key, F.explode(identities).alias("name")).where(~F.startswith("name", F.lit("##")))
    hits = said.join(match_names(said, "name", kb, "brand", threshold), "name").select(key, F.col("tag").alias("brand"))
    with_domains = hits.join(kb.select("brand", "domains"), "brand", "left")
    return with_domains.groupBy(key).agg(F.sort_array(F.collect_set("brand")).alias("brands"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("domains", F.array()))))).alias("official"))


def first_role(messages: DataFrame, key: str, relations: str, roles: DataFrame, threshold: float = ROLE) -> DataFrame:
    """(key, role): the first relation of a message that is near an internal role."""
    said = messages.select(key, F.posexplode(relations).alias("pos", "name"))
    hits = said.join(match_names(said, "name", roles, "role", threshold - 0.05), "name")
    return hits.groupBy(key).agg(F.min_by("tag", "pos").alias("role"))


# ---------------------------------------------------------------- clusters of names within one row


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@functools.lru_cache(maxsize=100_000)
def _close(a: str, b: str, threshold: float) -> bool:
    """Whether one text is within the other, or their similarity is above the threshold; bounds of it are tried first."""
    if a in b or b in a:
        return True
    m = difflib.SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > threshold and m.quick_ratio() > threshold and m.ratio() > threshold


def cluster_any(strings: list[str], threshold: float = 0.5, last: Callable[[str], bool] | None = None) -> list[list[str]]:
    """Greedy clusters in order: a string joins the first that has a member similar to it, or within it, or around it.

    last: ends the list with the first cluster whose first member it holds for; what joins none of these is left out.
    """
    out: list[list[str]] = []
    small: list[list[str]] = []
    ended = False
    for s in strings:
        low = s.lower()
        for c, members in zip(out, small, strict=True):
            if any(_close(low, x, threshold) for x in members):
                c.append(s)
                members.append(low)
                break
        else:
            if not ended:
                out.append([s])
                small.append([low])
                ended = last is not None and last(s)
    return out


def cluster_first(strings: list[str], threshold: float = 0.5) -> list[list[str]]:
    """As before, but compared with a cluster's first member only, and by similarity only."""
    out: list[list[str]] = []
    for s in strings:
        for c in out:
            if _ratio(s.lower(), c[0].lower()) > threshold:
                c.append(s)
                break
        else:
            out.append([s])
    return out


def cluster_close(strings: list[str], threshold: float = 0.85) -> list[list[str]]:
    """Pairs in order: each string takes the one closest to it among those that follow, if it is similar enough."""
    left, out = list(strings), []
    while left:
        s = left.pop(0)
        close = difflib.get_close_matches(s, left, n=1, cutoff=threshold)
        left = [x for x in left if x not in close]
        out.append([s, *close])
    return out


_CLUSTERS = ArrayType(ArrayType(StringType()))


@F.pandas_udf(_CLUSTERS)
def cluster_strings(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else cluster_any([x for x in a if x is not None]))


@F.pandas_udf(_CLUSTERS)
def cluster_strings_by_first(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else cluster_first([x for x in a if x is not None]))


@F.pandas_udf(_CLUSTERS)
def cluster_strings_close(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else cluster_close([x for x in a if x is not None]))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts from their matching blocks, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def expected_found(expected: pd.Series, found: pd.Series) -> pd.Series:
    """Share of expected entities that some found one is similar to (ratio 0.5)."""
    out = []
    for e, f in zip(expected, found, strict=True):
        e, f = list(e) if e is not None else [], list(f) if f is not None else []
        out.append(sum(any(_ratio(x, y) >= 0.5 for y in f) for x in e) / len(e) if e else None)
    return pd.Series(out, dtype="float64")


def expand_knowledge_base(spark: SparkSession, kb: DataFrame, found: DataFrame) -> DataFrame:
    """The knowledge base with newly found (brand, domains), domains of known brands united; nothing is written in place."""
    both = kb.select("brand", "domains").unionByName(found.select("brand", "domains"))
    return both.groupBy("brand").agg(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("domains")), F.lower))).alias("domains"))
