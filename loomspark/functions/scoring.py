"""Scalar scores of retrieval, response and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def cluster_count(n: Column) -> Column:
    """Clusters for n items: one below three, else a third, 2 to 20, n at most."""
    k = F.greatest(F.lit(2), F.least(F.floor(n / 3), F.lit(20)))
    return F.when(n < 3, F.lit(1)).otherwise(F.least(k, n)).cast("int")


def level_weight(level: Column, max_level: Column) -> Column:
    m = F.greatest(max_level, F.lit(1))
    return 1.0 - 0.1 * F.abs(level - m / 2.0) / m


def hop_score(depth: Column) -> Column:
    return 1.0 / (1.0 + depth * 0.5)


def temporal_bonus(created: Column, now: Column, weight: float = 0.05) -> Column:
    """weight halved for each 365 whole days of age; dates after now score above it; 0 without a date."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))
    days = F.floor(seconds / 86400)
    return F.coalesce(weight * F.pow(F.lit(0.5), days / 365.0), F.lit(0.0))


def coherence(in_query: Column, edges_into_query: Column, query_size: Column) -> Column:
    """0.15 for an entity of the query, else 0.075 for each out-edge into the query's entities, counted once for each of those."""
    return F.when(in_query, 0.15).otherwise(0.075 * edges_into_query * query_size)


def confidence(crag_quality: Column, reflection_mean: Column, sources: Column) -> Column:
    """Mean of the signals; without reflection scores (null) of two of them."""
    crag = F.when(crag_quality == "CORRECT", 0.9).when(crag_quality == "AMBIGUOUS", 0.5).otherwise(0.2)
    have = F.when(sources >= 5, 0.9).when(sources >= 2, 0.7).when(sources >= 1, 0.5).otherwise(0.1)
    return F.when(reflection_mean.isNull(), (crag + have) / 2).otherwise((crag + reflection_mean + have) / 3)


def warnings(crag_quality: Column, support: Column, sources: Column) -> Column:
    rules = [(crag_quality == "INCORRECT", fixed.WARN_INCORRECT), (crag_quality == "AMBIGUOUS", fixed.WARN_AMBIGUOUS), (F.coalesce(support, F.lit(1.0)) < 0.5, fixed.WARN_SUPPORT), (sources == 0, fixed.WARN_SOURCES)]
    return F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in rules]))


def crag_action(results: Column, judged_quality: Column) -> Column:
    """struct<quality, action>: without results INCORRECT, without a judgement AMBIGUOUS but to proceed, else by quality."""
    quality = F.when(results == 0, "INCORRECT").otherwise(F.coalesce(judged_quality, F.lit("AMBIGUOUS")))
    action = (
        F.when(results == 0, "WEB_SEARCH_FALLBACK").when(judged_quality.isNull(), "PROCEED").when(judged_quality == "INCORRECT", "WEB_SEARCH_FALLBACK").when(judged_quality == "AMBIGUOUS", "DECOMPOSE_AND_RETRY").otherwise("PROCEED")
    )
    return F.struct(quality.alias("quality"), action.alias("action"))


def failure_type(gold: Column, similarity: Column, retrieved: Column, quality: Column, support: Column, relevance: Column, usefulness: Column) -> Column:
    """Null where there is no failure or nothing to compare with; missing scores count as 1."""
    low = lambda c: F.coalesce(c, F.lit(1.0)) < 0.4
    kind = F.when(retrieved == 0, "no_retrieval").when(quality == "INCORRECT", "wrong_entity").when(low(support), "hallucination").when(low(relevance), "missing_context").when(low(usefulness), "wrong_reasoning").otherwise("partial_answer")
    return F.when((F.coalesce(F.length(gold), F.lit(0)) > 0) & (similarity <= 0.7), kind)


def access(enabled: bool, role: Column, user: Column, doc: Column, allowed_docs: Column, denied_docs: Column, acl_roles: Column, acl_users: Column) -> Column:
    """Role-based access; null allow lists allow all (empty ones nothing), null acl_roles means that no entry exists."""
    if not enabled:
        return F.lit(True)
    return (
        F.when(role == "admin", True)
        .when(F.coalesce(F.array_contains(denied_docs, doc), F.lit(False)), False)
        .when(allowed_docs.isNotNull() & ~F.array_contains(allowed_docs, doc), False)
        .when(acl_roles.isNull(), role.isin("admin", "user"))
        .when(~F.array_contains(acl_roles, role), False)
        .when(acl_users.isNotNull() & ~F.array_contains(acl_users, user), False)
        .otherwise(True)
    )
