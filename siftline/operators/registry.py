"""The registry: domains seen often enough, and clearly enough of one kind, are classified without a code change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import urls as U
from siftline.functions.text import contains_any


def sightings(pages: DataFrame, *, url: str, text: str, signals: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per domain: how often it was seen, the sum of each category's signal score, and five sample URLs.

    A page's score for a category is the share of the category's signals that it shows.
    """
    low = F.lower(F.col(text))
    scores = {kind: reduce(lambda a, b: a + b, [F.contains(low, F.lit(s)).cast("int") for s in own]) / F.lit(float(len(own))) for kind, own in signals.items()}
    seen = pages.select(U.host(F.col(url)).alias("domain"), F.col(url).alias("url"), *[s.alias(k) for k, s in scores.items()])
    # Samples from the distinct URLs of a domain, by rank, so that a domain with very many pages gathers five and no more.
    sums = seen.groupBy("domain").agg(F.count("*").alias("sightings"), *[F.round(F.sum(k), 6).alias(k) for k in signals])

    first = seen.select("domain", "url").distinct().withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("url"))).where("n <= 5")
    samples = first.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("samples"))
    return sums.join(samples, "domain")


def proposals(seen: DataFrame, signals: dict[str, tuple[str, ...]], *, least: int = vocab.REGISTRY_SIGHTINGS) -> DataFrame:
    """Domains of at least ``least`` sightings with their best category and its confidence."""
    kinds = list(signals)
    best = F.greatest(*kinds)
    category = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in kinds])
    second = F.element_at(F.sort_array(F.array(*kinds), asc=False), 2)
    confidence = F.round(F.least(F.lit(1.0), best / F.greatest(F.lit(1.0), F.col("sightings") / 2)), 6)
    return seen.where(F.col("sightings") >= least).select("domain", "sightings", category.alias("category"), confidence.alias("confidence"), best.alias("best"), second.alias("second"), "samples")


def precise(samples: Column) -> Column:
    """The category that sample addresses prove by themselves: two of its markers, or one that decides; null if none does."""
    low = F.lower(F.coalesce(samples, F.lit("")))
    out = F.lit(None).cast("string")
    for kind, markers in reversed(vocab.PRECISE_SIGNALS.items()):
        seen = reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in markers])
        out = F.when((seen >= 2) | contains_any(low, [m for m in markers if m in vocab.DECISIVE_SIGNALS]), F.lit(kind)).otherwise(out)
    return out


def promotions(proposed: DataFrame, *, confidence: float = vocab.REGISTRY_CONFIDENCE, lead: float = vocab.REGISTRY_LEAD) -> DataFrame:
    """Proposals that precise signals prove, or that are confident enough with a best category that leads the second clearly."""
    proven = precise(F.col("samples"))
    sure = (F.col("confidence") >= confidence) & (F.col("best") >= lead * F.col("second"))
    return proposed.withColumn("category", F.coalesce(proven, F.when(sure, F.col("category")))).where("category IS NOT NULL")


def grown(registry: DataFrame, promoted: DataFrame, demoted: DataFrame) -> DataFrame:
    """The registry (domain, category, promoted_by) after a pass: what was promoted joins it unless it is there, what was demoted leaves it."""
    fresh = promoted.select("domain", "category", F.lit("auto").alias("promoted_by")).join(registry, "domain", "left_anti")
    return registry.unionByName(fresh).join(demoted.select("domain").distinct(), "domain", "left_anti")
