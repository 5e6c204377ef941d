"""Growing the knowledge base: pages followed from known sites to the addresses they give, as a frontier over tables.

Fetching and name lookup are given as functions and off by default; the loop itself needs no network. Each level is
written to the shared folder, so a lost executor costs a level at most and the plan does not grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.domains import FILE_ENDINGS, blocked_for_expansion, brand_prefixes, host_allowed, host_of, link_priority, normalize_domain, registrable_naive, site_roots, token_overlap, visit_key
from veriloom.functions.text import page_emails
from veriloom.operators.evaluate import top_links
from veriloom.operators.matching import fuzzy_ratio
from veriloom.session import shared_path

#: Most hops from a seed, and most pages fetched in all.
DEPTH, BUDGET = 3, 80
_HREF = r"(?i)<a[^>]*\shref=[\"']([^\"']+)[\"']"


def crawl(spark: SparkSession, seeds: DataFrame, allowed: list[str], fetch: Callable[[str], str | None], depth: int = DEPTH, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(visited: url, hop; emails: email, url) from seeds (url) within the allowed hosts.

    A page is fetched once; of its links the 15 (first hop) or 6 most promising are followed. ``budget`` is the feature
    that keeps a crawl polite, not a limit on data.
    """
    import re

    root = shared_path(spark, "crawl")
    hosts = F.array(*[F.lit(h) for h in allowed]) if allowed else F.array().cast("array<string>")
    frontier = seeds.select(visit_key(F.col("url")).alias("url")).where(host_allowed(host_of(F.col("url")), hosts)).distinct()
    visited: DataFrame | None = None
    emails: DataFrame | None = None
    fetched = 0

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            pages = [fetch(u) for u in urls]
            links = [[urldefrag(urljoin(u, h))[0] for h in re.findall(_HREF, p)] if p else [] for u, p in zip(urls, pages, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array([p is not None for p in pages], pa.bool_()), pa.array(links, pa.list_(pa.string())), pa.array([page_emails(p) for p in pages], pa.list_(pa.string()))], names=["url", "ok", "links", "emails"])

    for hop in range(depth + 1):
        todo = frontier.orderBy("url").limit(max(0, budget - fetched))
        todo.mapInArrow(load, "url string, ok boolean, links array<string>, emails array<string>").write.parquet(f"{root}/hop-{hop}")
        got = spark.read.parquet(f"{root}/hop-{hop}")
        n = got.count()
        fetched += n
        pages = got.select("url", F.lit(hop).alias("hop"))
        visited = pages if visited is None else visited.unionByName(pages)
        found = got.select("url", F.explode("emails").alias("email"))
        emails = found if emails is None else emails.unionByName(found)
        if not n or fetched >= budget or hop == depth:
            break
        links = got.select(F.col("url").alias("src"), F.lit(hop).alias("hop"), F.explode("links").alias("link"))
        links = links.where(F.col("link").rlike("^https?://") & ~F.lower(F.regexp_replace("link", r"[?#].*$", "")).rlike(r"\.(?:" + "|".join(FILE_ENDINGS) + ")$"))
        links = links.where(host_allowed(host_of(F.col("link")), hosts)).select("src", "hop", visit_key(F.col("link")).alias("link")).distinct()
        chosen = top_links(links.withColumn("priority", link_priority(F.col("link"))), "src", "link", "priority", "hop")
        frontier = chosen.select(F.col("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
    first = emails.groupBy(F.lower("email").alias("k")).agg(F.min_by(F.struct("email", "url"), F.struct("url", "email")).alias("x"))
    return visited, first.select("x.email", "x.url")


def existing_domains(emails: DataFrame, resolve: Callable[[str], bool]) -> DataFrame:
    """Addresses whose domain exists; every domain is looked up once."""
    with_domain = emails.withColumn("_d", F.lower(F.substring_index("email", "@", -1)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(resolve(d)) for d in batch.column("_d").to_pylist()], pa.bool_()))

    alive = with_domain.select("_d").distinct().mapInArrow(look, "_d string")
    return with_domain.join(alive, "_d").drop("_d")


def official_and_other(emails: DataFrame, cores: list[str], personal: list[str]) -> DataFrame:
    """emails with ``kind``: official if the host is one of the identity's domains or below it; personal ones left out.
    No domains at all is an error, as everything would pass as other."""
    if not cores:
        raise ValueError("no identity domains")
    host = F.lower(F.substring_index("email", "@", -1))
    core = F.array(*[F.lit(c) for c in cores])
    rows = emails.where(~F.lower("email").isin([p.lower() for p in personal])) if personal else emails
    return rows.withColumn("kind", F.when(host_allowed(host, core), "official").otherwise("other"))


# ---------------------------------------------------------------- domains of an identity


def allowed_domains(plans: DataFrame, key: str, urls: str, hints: str) -> DataFrame:
    """(key, domain) a crawl of a plan may touch: hosts of its URLs, their registrable domains, and its hints."""
    hosts = F.transform(site_roots(F.col(urls)), host_of)
    rows = plans.select(key, F.explode(F.array_distinct(F.concat(hosts, F.transform(hosts, registrable_naive), F.transform(F.coalesce(F.col(hints), F.array().cast("array<string>")), normalize_domain)))).alias("domain"))
    return rows.where("domain is not null and domain != ''").distinct()


def validated_keeps(proposed: DataFrame, emails: DataFrame, domain: str = "domain") -> DataFrame:
    """Proposed domains that some found address really has."""
    seen = emails.select(F.lower(F.substring_index("email", "@", -1)).alias("_d")).distinct()
    return proposed.withColumn("_n", normalize_domain(F.col(domain))).join(seen, F.col("_n") == F.col("_d"), "left_semi").drop("_n")


def aligned_with_brand(domains: DataFrame, cores: DataFrame) -> DataFrame:
    """domains (domain) whose first label is close to that of one of the identity's few known domains (domain): the same
    beginning, a common part between hyphens, or a similarity of 0.65 at similar length. Government domains never are."""
    known = [r[0] for r in cores.select(normalize_domain(F.col("domain"))).distinct().limit(1001).collect()]
    if len(known) > 1000:
        raise ValueError("more than 1,000 domains of one identity")
    label = F.substring_index(normalize_domain(F.col("domain")), ".", 1)
    out = domains.where(~blocked_for_expansion(F.col("domain"))).withColumn("_l", label)
    if not known:
        return out.where("false").drop("_l")
    tests = F.lit(False)
    for k in known:
        first = k.split(".")[0]
        near = F.abs(F.length("_l") - len(first)) <= max(3, len(first) // 2)
        tests = tests | F.arrays_overlap(brand_prefixes(F.col("domain")), brand_prefixes(F.lit(k))) | token_overlap(F.col("_l"), F.lit(first)) | (near & (fuzzy_ratio("_l", F.lit(first)) >= 0.65))
    return out.where(F.coalesce(tests, F.lit(False))).drop("_l")


def effective_cores(cores: DataFrame, keeps: DataFrame, allowed: DataFrame, emails: DataFrame) -> DataFrame:
    """(domain) of an identity: its known ones, proposals seen in addresses, allowed ones seen in addresses, and seen
    ones aligned with the known."""
    norm = lambda df: df.select(normalize_domain(F.col("domain")).alias("domain"))
    seen = emails.select(F.lower(F.substring_index("email", "@", -1)).alias("domain")).distinct()
    parts = [norm(cores), norm(validated_keeps(keeps, emails)), norm(allowed).join(seen, "domain", "left_semi"), aligned_with_brand(seen, cores)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("domain is not null and domain != ''").distinct()


def merged_domains(*parts: DataFrame) -> DataFrame:
    """(domain) of several tables, each once."""
    out = parts[0].select("domain")
    for p in parts[1:]:
        out = out.unionByName(p.select("domain"))
    return out.select(normalize_domain(F.col("domain")).alias("domain")).where("domain is not null and domain != ''").distinct()


def sitemap_candidates(locations: DataFrame, allowed: list[str], most: int = 30) -> DataFrame:
    """The most promising (url) of sitemaps: by priority, without a file's ending, near the root. The number is the feature."""
    hosts = F.array(*[F.lit(h) for h in allowed])
    rows = locations.select(visit_key(F.col("url")).alias("url")).distinct().where(host_allowed(host_of(F.col("url")), hosts))
    path = F.regexp_replace("url", r"^(?i:[a-z]+:)?//[^/]*", "")
    rows = rows.withColumn("priority", link_priority(F.col("url"))).withColumn("leaf", path.rlike(r"\.[A-Za-z0-9]{2,5}$").cast("int")).withColumn("depth", F.size(F.filter(F.split(path, "/"), lambda x: x != "")))
    return rows.orderBy(F.desc("priority"), "leaf", "depth", "url").limit(most)
