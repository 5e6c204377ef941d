"""Items of varying length into containers of fixed capacity, by hierarchical residual packing.

Items longer than the capacity are cut into full pieces and a rest; full pieces are containers by themselves. All other
items are dealt by hash into groups of at most ``GROUP``; each group is packed best-fit. Containers that are nearly full, or
into which not even the least filled underfull container of the run would go, are final. The others are the items of the
next round, dealt anew into groups of at most ``GROUP``. Rounds end when one group was enough, or when a round joined fewer
than ``LEAST_GAIN`` of its items. No task ever holds more than one group, whatever the sizes.

Items, pieces and containers are numbered by row, not by hash, so no two share a number within a run.

Edge cases: items of size 0, null sizes and null texts take no room and get piece 0 in container 0; equal items are packed
like any others (ties by number); repeated keys are items of their own; an empty table gives no rows; a capacity below 1 is
an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.token_sizes import TOKENIZER_DIR, with_sizes
from veriloom.session import shared_path, table

#: Most items of a group, the fill from which a container is final, the share of its items that a round must join for another.
GROUP, FULL, LEAST_GAIN = 20_000, 0.995, 0.002
_LOCAL = 26  # bits of a container's number within its group


def groups_for(items: int) -> int:
    """So many groups that hashing leaves room in each: four fifths of GROUP on average, one group for a last round."""
    return 1 if items <= GROUP else -(-items * 5 // (GROUP * 4))


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item (in the given order of items), by best fit in order of falling size."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    out = [0] * len(sizes)
    levels: list[int] = []  # residuals that some open container has
    open_at: dict[int, list[int]] = {}
    count = 0
    for k in order:
        s = sizes[k]
        at = bisect_left(levels, s)
        if at == len(levels):
            c, rest = count, capacity - s
            count += 1
        else:
            level = levels[at]
            c = open_at[level].pop()
            if not open_at[level]:
                del open_at[level]
                levels.pop(at)
            rest = level - s
        out[k] = c
        if rest > 0:
            if rest not in open_at:
                open_at[rest] = []
                insort(levels, rest)
            open_at[rest].append(c)
    return out


def _round(items: DataFrame, number: int) -> DataFrame:
    """One best-fit round: (run_name, capacity, item, size, grp) -> with the container ``box`` of each item and its fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        boxes = best_fit(pdf["size"].tolist(), int(pdf["capacity"].iloc[0]))
        grp = int(pdf["grp"].iloc[0])
        pdf["box"] = [(number << 56) | (grp << _LOCAL) | (b + 1) for b in boxes]
        pdf["fill"] = pdf.groupby("box")["size"].transform("sum")
        return pdf[["run_name", "capacity", "item", "size", "box", "fill"]]

    schema = "run_name string, capacity bigint, item bigint, size bigint, box bigint, fill bigint"
    return items.groupBy("run_name", "grp").applyInPandas(pack, schema)


def _dealt(items: DataFrame, counts: dict[str, int], number: int) -> DataFrame:
    """items with the group of each, by hash among the groups of its run."""
    groups = F.element_at(F.create_map(*[x for run, n in counts.items() for x in (F.lit(run), F.lit(groups_for(n)))]), F.col("run_name"))
    return items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(number)), groups.cast("long")))


def pack(spark: SparkSession, sizes: DataFrame, key: str, size: str, runs: DataFrame) -> DataFrame:
    """(run_name, key, piece_no, piece_tokens, container) for every item of sizes and every run (run_name, capacity_tokens).

    runs is a small list of settings: it is multiplied with the items on purpose, and an error if longer than 1,000.
    """
    settings = [(r[0], int(r[1])) for r in runs.select("run_name", "capacity_tokens").where("capacity_tokens is not null").limit(1001).collect()]
    if len(settings) > 1000 or any(c < 1 for _, c in settings):
        raise ValueError("too many runs, or a capacity below 1")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("run_name"), F.lit(c).cast("long").alias("capacity")) for n, c in settings])) if settings else None
    empty = "run_name string, capacity bigint"
    base = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("total"))
    if each is None:
        return base.join(spark.createDataFrame([], empty), F.lit(False), "inner").select("run_name", F.col("key").alias(key), F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("piece_tokens"), F.lit(0).cast("long").alias("container"))
    path = shared_path(spark, "packing")
    base.write.parquet(f"{path}/sizes")  # measured once, read for each kind of piece
    cut = spark.read.parquet(f"{path}/sizes").select("key", "total", each.alias("r")).select("key", "total", "r.run_name", "r.capacity")
    whole, rest = F.expr("total div capacity"), F.expr("total % capacity")
    full: Column = F.explode(F.sequence(F.lit(1).cast("long"), whole))
    pieces_full = cut.where("total >= capacity").select("run_name", "key", full.alias("piece_no"), F.col("capacity").alias("piece_tokens"))
    pieces_full = pieces_full.withColumn("container", -F.monotonically_increasing_id() - 1)
    nothing = cut.where("total = 0").select("run_name", "key", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("piece_tokens"), F.lit(0).cast("long").alias("container"))
    small = cut.where("total % capacity > 0").select("run_name", "capacity", "key", F.when(F.col("total") > F.col("capacity"), whole + 1).otherwise(F.lit(0)).alias("piece_no"), rest.alias("size"))
    small.withColumn("item", F.monotonically_increasing_id()).write.parquet(f"{path}/items")
    items = spark.read.parquet(f"{path}/items")
    current = items.select("run_name", "capacity", "item", "size")
    counts = {r[0]: r[1] for r in current.groupBy("run_name").count().collect()}
    rounds: list[DataFrame] = []
    while counts:
        number = len(rounds) + 1
        _round(_dealt(current, counts, number), number).write.parquet(f"{path}/round-{number}")
        done = spark.read.parquet(f"{path}/round-{number}")
        rounds.append(done)
        boxes = done.groupBy("run_name", "capacity", "box").agg(F.max("fill").alias("size"))
        under = boxes.where(F.col("size") < F.ceil(F.col("capacity") * F.lit(FULL)))
        left = F.when(F.col("size") < F.ceil(F.col("capacity") * F.lit(FULL)), F.col("size"))
        after = {r[0]: r[1:] for r in boxes.groupBy("run_name").agg(F.count(F.lit(1)), F.min(left)).collect()}
        # another round for the runs that had more than one group and in which this one still joined enough
        more = {run: least for run, (n, least) in after.items() if least is not None and groups_for(counts[run]) > 1 and (counts[run] - n) >= LEAST_GAIN * counts[run]}
        if not more:
            break
        least = F.element_at(F.create_map(*[x for run, v in more.items() for x in (F.lit(run), F.lit(v))]), F.col("run_name"))
        current = under.where(F.col("run_name").isin(list(more)) & (F.col("size") + least <= F.col("capacity"))).select("run_name", "capacity", F.col("box").alias("item"), "size")
        counts = {r[0]: r[1] for r in current.groupBy("run_name").count().collect()}
    if rounds:
        placed = rounds[0].select("run_name", "item", F.col("box").alias("container"))
        for r in rounds[1:]:
            up = r.select("run_name", F.col("item").alias("container"), F.col("box").alias("higher"))
            placed = placed.join(up, ["run_name", "container"], "left").select("run_name", "item", F.coalesce("higher", "container").alias("container"))
    else:
        placed = items.select("run_name", "item", F.lit(0).cast("long").alias("container"))
    packed = items.join(placed, ["run_name", "item"]).select("run_name", "key", "piece_no", F.col("size").alias("piece_tokens"), "container")
    return packed.unionByName(pieces_full).unionByName(nothing).withColumnRenamed("key", key)


def _sizes(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    return with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", folder=folder)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of one longer than the capacity, for each run of pack_targets."""
    return pack(spark, _sizes(spark, sf_dir), "doc_id", "n_tokens", table(spark, sf_dir, "pack_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each run."""
    boxes = p7_containers(spark, sf_dir).where("piece_tokens > 0").groupBy("run_name", "container").agg(F.sum("piece_tokens").alias("fill"))
    runs = table(spark, sf_dir, "pack_targets")
    return (
        boxes.join(runs, "run_name")
        .groupBy("run_name", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
        .withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )


QUERIES = {"p7_containers": p7_containers, "p7_report": p7_report}
