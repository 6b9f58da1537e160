"""Score breakdowns as stored by the scorers: built, read in both forms, summed up, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

# Factors of a stored breakdown in the order in which ties are shown.
SHOWN = ["cross_source", "source_quality", "threat_type_severity", "threat_actor", "mitre_techniques", "ai_confidence", "keywords", "entropy", "geo_risk", "domain_age"]
# Categories of the simple breakdown -> (flat key, nested keys of which the first with points counts, most points).
CATEGORIES = {
    "Cross-Source Validation": ("crossSource", ["cross_source"], 40), "IOC Characteristics": ("typeSpecific", ["type_specific", "nlp"], 25), "Entropy (DGA Detection)": ("entropy", ["entropy"], 20),
    "Keyword Context": ("keywords", ["keywords"], 15), "Source Severity": ("sourceSeverity", ["source_severity", "source_quality"], 15),
}


def stored(scored: DataFrame) -> DataFrame:
    """`scored` with `breakdown`: the factors as nested JSON, {factor: {score}}."""
    return scored.withColumn("breakdown", F.to_json(F.struct(*[F.struct(F.col(c).alias("score")).alias(c) for c in S.FACTORS])))


def _points(v: Column, *paths: str) -> Column:
    """The number at the first path that has one; else 0."""
    return F.coalesce(*[F.try_variant_get(v, p, "double") for p in paths], F.lit(0.0))


def score_of(v: Column, flat: str, nested: list[str]) -> Column:
    """Of a parsed breakdown: the flat number, or else that of a nested entry; an entry without points gives way to the next."""
    each = [_points(v, f"$.{flat}", f"$.{n}.score") for n in nested]
    return F.coalesce(*[F.nullif(e, F.lit(0.0)) for e in each], F.lit(0.0))


def categories(v: Column) -> Column:
    """The categories of a parsed breakdown, flat or nested, as structs (category, score, max_score); the last only with points."""
    rows = [F.struct(F.lit(name).alias("category"), score_of(v, flat, nested).alias("score"), F.lit(most).alias("max_score")) for name, (flat, nested, most) in CATEGORIES.items()]
    last = list(CATEGORIES)[-1]
    return F.filter(F.array(*rows), lambda x: (x["category"] != last) | (x["score"] > 0))


def summary(v: Column, types: Column, actors: Column, techniques: Column) -> Column:
    """The summary of a parsed nested breakdown: the sums of both halves, and what the lists say."""
    part = lambda names: reduce(lambda a, b: a + b, [_points(v, f"$.{n}.score") for n in names])
    return F.struct(
        part(S.FACTORS[:6]).alias("traditional_score"), part(S.FACTORS[6:]).alias("ai_score"), (F.size(F.coalesce(actors, T.literals([]))) > 0).alias("has_threat_actor"),
        (F.size(F.coalesce(techniques, T.literals([]))) > 0).alias("has_mitre"), F.get(types, F.lit(0)).alias("primary_threat"),
    )


def fallback_factors(v: Column, k: int = 6) -> Column:
    """The k largest factors of a parsed nested breakdown, as structs (factor, score, max_score): for rows without stored top factors."""
    each = F.array(*[F.struct((-_points(v, f"$.{n}.score")).alias("key"), F.lit(i).alias("i"), F.lit(n).alias("factor")) for i, n in enumerate(SHOWN)])
    best = F.slice(F.sort_array(F.filter(each, lambda x: x["key"] < 0)), 1, k)
    return F.transform(best, lambda x: F.struct(x["factor"].alias("factor"), (-x["key"]).alias("score"), most_of(x["factor"]).alias("max_score")))


def most_of(factor: Column) -> Column:
    from .export import factor_max

    return factor_max(factor)


def enhanced(rows: DataFrame) -> DataFrame:
    """One struct a row for display, `enhanced`, with defaults for what a row lacks: needs event_id and severity."""
    has = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    none = F.struct(F.lit(0.0).alias("traditional_score"), F.lit(0.0).alias("ai_score"), F.lit(False).alias("has_threat_actor"), F.lit(False).alias("has_mitre"), F.lit(None).cast("string").alias("primary_threat"))
    level = F.coalesce(F.nullif(has("severity_ai", "string"), F.lit("")), F.nullif("severity", F.lit("")), F.lit("low"))
    shape = "struct<traditional_score:double,ai_score:double,has_threat_actor:boolean,has_mitre:boolean,primary_threat:string>"
    return rows.withColumn("enhanced", F.struct(
        F.coalesce(has("risk_score", "int"), F.lit(0)).alias("total_score"), level.alias("severity"), F.coalesce(has("severity_th", "string"), F.lit("")).alias("severity_th"),
        F.coalesce(has("breakdown", "string"), F.lit("{}")).alias("breakdown"), F.coalesce(has("top_factors", "array<struct<factor:string,score:int>>"), F.array().cast("array<struct<factor:string,score:int>>")).alias("top_factors"),
        F.coalesce(has("summary", shape), none).alias("summary"),
    ))
