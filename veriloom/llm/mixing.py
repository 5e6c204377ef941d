"""Sources mixed to target shares over the course of training.

Each source has a weight schedule over training time (piecewise linear), whose integral is its target share; the demand
for its tokens up to a time is the total times the integral up to it. A source's documents, in an order of their own for
every repetition, are laid along its tokens, and inverting the demand gives each the time at which it is due. The whole is
range-sorted by that time. Without a given total, the largest is taken at which every source that has documents can
reach its share within its repetitions.

Running sums are taken in two steps, within hash ranges of bounded size and over the ranges' totals, so a source that
holds most of the documents is spread over as many tasks as it needs.

Edge cases: a source without documents, or without a target, contributes nothing and is reported with its reason;
documents of null or empty text have no tokens and are never taken; shares are taken relative to their sum over the
sources that have tokens; max_repeats of null counts as 1, below 1 as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.llm.token_sizes import TOKENIZER_DIR, with_sizes
from veriloom.session import shared_path, table

#: Documents that a range of the two-step running sum should hold; most sources of a target list.
RANGE, MOST_SOURCES = 20_000, 100_000
#: Knots of the schedule and, by default, the weight of small against large sources there: those repeated most come late.
KNOTS = (0.0, 0.5, 1.0)


def schedules(targets: dict[str, tuple[float, int]], tilt: float = 0.5) -> dict[str, list[float]]:
    """Weights of each source at the knots: its share, tilted towards the end the more it may be repeated.

    At every knot the weights add up to 1 and over time each source's average is its share: the tilts are balanced by share.
    """
    repeats = {s: float(r) for s, (_, r) in targets.items()}
    total = sum(sh for sh, _ in targets.values()) or 1.0
    mean = sum(sh / total * repeats[s] for s, (sh, _) in targets.items())
    most = max([abs(r - mean) for r in repeats.values()] or [0.0]) or 1.0
    out = {}
    for s, (sh, _) in targets.items():
        lean = tilt * (repeats[s] - mean) / most
        out[s] = [sh / total * (1 - lean), sh / total, sh / total * (1 + lean)]
    return out


def integral(weights: list[float], knots: tuple[float, ...] = KNOTS) -> float:
    """The area under piecewise-linear weights, which is the share of all tokens that a source is due."""
    return sum((knots[k + 1] - knots[k]) * (weights[k] + weights[k + 1]) / 2 for k in range(len(knots) - 1))


def invert(share: Column, weights: list[float | Column], knots: tuple[float, ...] = KNOTS) -> Column:
    """The time at which the integral of piecewise-linear weights reaches a value (a share of the total)."""
    w = [x if isinstance(x, Column) else F.lit(float(x)) for x in weights]
    begun = [F.lit(0.0)]
    for k in range(len(knots) - 1):
        begun.append(begun[-1] + F.lit((knots[k + 1] - knots[k]) / 2) * (w[k] + w[k + 1]))
    out = F.lit(float(knots[-1]))
    for k in reversed(range(len(knots) - 1)):
        a, b = float(knots[k]), float(knots[k + 1])
        slope = (w[k + 1] - w[k]) / F.lit(b - a)
        y = share - begun[k]
        even = F.lit(a) + F.when(w[k] > 0, y / w[k]).otherwise(F.lit(0.0))
        bent = F.lit(a) + (-w[k] + F.sqrt(F.greatest(w[k] * w[k] + 2 * slope * y, F.lit(0.0)))) / F.when(F.abs(slope) < 1e-15, F.lit(1.0)).otherwise(slope)
        t = F.when(F.abs(slope) < 1e-15, even).otherwise(bent)
        out = F.when(share <= begun[k + 1], F.least(F.greatest(t, F.lit(a)), F.lit(b))).otherwise(out)
    return out


class Mixture:
    """A plan of how the documents (key, source, n_tokens) are drawn; reads them once for totals, once for each result."""

    def __init__(self, spark: SparkSession, docs: DataFrame, targets: DataFrame, total: int | None = None, tilt: float = 0.5, schedule: dict[str, list[float]] | None = None) -> None:
        """total: tokens to draw in all. schedule: each source's weights at the KNOTS, of any scale, in place of the tilted
        shares; their integrals then are the target shares."""
        path = shared_path(spark, "mixing")
        docs.write.parquet(path)
        self.docs = spark.read.parquet(path)
        rows = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.targets = {r[0]: (float(r[1]), 1 if r[2] is None else max(0, int(r[2]))) for r in rows}
        if schedule is not None:
            if any(len(w) != len(KNOTS) or min(w) < 0 for w in schedule.values()):
                raise ValueError(f"a schedule needs {len(KNOTS)} weights of 0 or more")
            self.targets = {s: (integral(schedule[s]), r) for s, (_, r) in self.targets.items() if s in schedule and integral(schedule[s]) > 0}
        named = F.broadcast(spark.createDataFrame([(s,) for s in self.targets], "source string"))
        have = self.docs.where(F.col("n_tokens") > 0).join(named, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()
        self.have = {r[0]: (int(r[1]), int(r[2])) for r in have}
        live = {s: t for s, t in self.targets.items() if s in self.have and t[1] > 0}
        shares = sum(sh for sh, _ in live.values()) or 1.0
        self.live = {s: (sh / shares, r) for s, (sh, r) in live.items()}
        largest = min([self.have[s][0] * r / sh for s, (sh, r) in self.live.items()] or [0])
        self.total = int(largest if total is None else total)
        if schedule is None:
            self.weights = schedules(self.live, tilt)
        else:
            self.weights = {s: [x / shares for x in schedule[s]] for s in self.live}
        # what a source is due is the integral of its weights, as far as its documents and repetitions reach
        self.demand = {s: min(int(round(integral(self.weights[s]) * self.total, 6)), self.have[s][0] * r) for s, (_, r) in self.live.items()}

    def draws(self) -> DataFrame:
        """(key, source, n_tokens, repeat, begins): every copy that is drawn, with the tokens of its source before it."""
        empty = self.docs.where("false").select("key", "source", "n_tokens", F.lit(0).alias("repeat"), F.lit(0).cast("long").alias("begins"))
        if not self.live:
            return empty
        copies = (
            self.docs.where(F.col("n_tokens") > 0)
            .join(self._plan(), "source")
            .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.greatest(F.col("need"), F.lit(1)))))
            .withColumn("h", F.xxhash64("key", "repeat", F.lit("mix")))
            .withColumn("part", F.floor((F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.col("ranges")).cast("long"))
        )
        totals = copies.groupBy("source", "repeat", "part").agg(F.sum("n_tokens").alias("part_tokens"))
        before = F.coalesce(F.sum("part_tokens").over(W.partitionBy("source").orderBy("repeat", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        totals = totals.withColumn("before", before).drop("part_tokens")
        inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "repeat", "part").orderBy("h", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        laid = copies.withColumn("inside", inside).join(totals, ["source", "repeat", "part"]).withColumn("begins", F.col("before") + F.col("inside"))
        # a copy is drawn if more than half of it lies within the demand
        return laid.where(F.col("begins") * 2 + F.col("n_tokens") <= F.col("wanted") * 2).select("key", "source", "n_tokens", "repeat", "begins")

    def _plan(self) -> DataFrame:
        """A row for each live source, MOST_SOURCES at most, to be broadcast."""
        rows = [(s, -(-self.demand[s] // self.have[s][0]), max(1, -(-self.have[s][1] // RANGE)), self.demand[s], integral(self.weights[s]), [float(x) for x in self.weights[s]]) for s in self.live]
        return F.broadcast(self.docs.sparkSession.createDataFrame(rows, "source string, need int, ranges bigint, wanted bigint, area double, weights array<double>"))

    def counts(self) -> DataFrame:
        """(key, source, times_taken) of every document, 0 for those not drawn."""
        taken = self.draws().groupBy("key").agg(F.count(F.lit(1)).alias("times_taken"))
        return self.docs.join(taken, "key", "left").select("key", "source", "n_tokens", F.coalesce("times_taken", F.lit(0)).alias("times_taken"))

    def shares(self) -> DataFrame:
        """Target and actual share of each source, with why it misses."""
        spark = self.docs.sparkSession
        per_key = self.draws().groupBy("source", "key").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("tokens"))
        got = {r[0]: r[1:] for r in per_key.groupBy("source").agg(F.sum("tokens"), F.sum("times"), F.count(F.lit(1)), F.max("times")).collect()}
        total = sum(int(x[0]) for x in got.values()) or 1
        rows = []
        for s, (sh, r) in sorted(self.targets.items()):
            tokens, times, docs, most = got.get(s, (0, 0, 0, 0))
            why = "no document with tokens" if s not in self.have else "no repeats allowed" if r < 1 else "capped" if self.demand[s] < int(self.live[s][0] * self.total) else "reached"
            rows.append((s, sh, int(tokens) / total, self.live.get(s, (0.0, 0))[0], int(tokens), int(times), int(docs), int(most), r, why))
        return spark.createDataFrame(rows, "source string, target_share double, actual_share double, reachable_target double, tokens bigint, copies bigint, documents bigint, most_times bigint, max_repeats int, status string")

    def curriculum(self) -> DataFrame:
        """(key, source, repeat, n_tokens, position): every copy with its place in training, range-sorted by it."""
        if not self.live:
            return self.draws().withColumn("position", F.lit(None).cast("double")).select("key", "source", "repeat", "n_tokens", "position")
        at = (F.col("begins") + F.col("n_tokens") / 2) / F.greatest(F.col("wanted"), F.lit(1)) * F.col("area")
        rows = self.draws().join(self._plan(), "source").withColumn("position", invert(at, [F.col("weights")[k] for k in range(len(KNOTS))]))
        return rows.select("key", "source", "repeat", "n_tokens", "position").orderBy("position", "key", "repeat")


def _mixture(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> Mixture:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    return Mixture(spark, with_sizes(docs, "text", folder=folder), table(spark, sf_dir, "mix_targets"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return _mixture(spark, sf_dir).counts().withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return _mixture(spark, sf_dir).shares()


def p8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn copy in order of training."""
    return _mixture(spark, sf_dir).curriculum().withColumnRenamed("key", "doc_id")


QUERIES = {"p8_counts": p8_counts, "p8_shares": p8_shares, "p8_curriculum": p8_curriculum}
