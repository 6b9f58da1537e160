"""The factors of the risk scorers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from . import text as T


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def cross_source(sources: Column) -> Column:
    """0, 5, 15, 25 points for 0 to 3 distinct sources, then 5 more each up to 40."""
    n = F.size(F.array_distinct(F.coalesce(sources, T.literals([]))))
    return F.when(n == 0, 0).when(n == 1, 5).when(n == 2, 15).when(n == 3, 25).otherwise(F.least(30 + 5 * (n - 3), F.lit(40)))


def source_quality(sources: Column) -> Column:
    """15 points a trusted source, 8 a news source, 5 any other, repeats counted, at most 40."""
    tier = {"trusted": 15, "news": 8}
    points = F.transform(sources, lambda s: F.coalesce(T.lookup(tier, T.source_tier(s)), F.lit(5)))
    return F.least(F.coalesce(total(points), F.lit(0)), F.lit(40))


def keywords(text: Column) -> Column:
    return F.least(T.count_hits(F.lower(F.coalesce(text, F.lit(""))), dims.SERVICE_KEYWORDS) * 5, F.lit(25))


def entropy_value(value: Column, kind: Column) -> Column:
    """The service entropy of domains, urls and host names; null for other kinds."""
    return F.when(kind.isin("domain", "url", "hostname"), T.entropy_service(value))


def entropy_points(e: Column) -> Column:
    return F.when(e > 4.0, 15).when(e > 3.5, 10).when(e > 3.0, 5).otherwise(0)


def geo_risk(country: Column, enabled: bool = False) -> Column:
    """15 points for a high-risk country; switched off by default, as the scorer does not use it."""
    return F.when(country.isin(dims.HIGH_RISK_COUNTRIES), 15).otherwise(0) if enabled else F.lit(0)


def domain_age(days: Column, kind: Column) -> Column:
    points = F.when(days < 30, 20).when(days < 90, 15).when(days < 180, 10).when(days < 365, 5).otherwise(0)
    return F.when(kind.isin("domain", "url", "hostname"), points).otherwise(0)


def threat_type(types: Column) -> Column:
    """The first two types' points, at most 30, and 5 more for three or more types."""
    points = F.transform(F.slice(types, 1, 2), lambda t: F.coalesce(T.lookup({k: v[1] for k, v in dims.THREAT_TYPES.items()}, t), F.lit(dims.UNKNOWN_TYPE[1])))
    return F.least(F.least(F.coalesce(total(points), F.lit(0)), F.lit(30)) + F.when(F.size(types) >= 3, 5).otherwise(0), F.lit(35))


def threat_type_level(types: Column) -> Column:
    """The most severe level among the known types; 5 where there are none."""
    levels = F.transform(types, lambda t: F.coalesce(T.lookup({k: v[0] for k, v in dims.THREAT_TYPES.items()}, t), F.lit(5)))
    return F.coalesce(F.array_min(levels), F.lit(5))


def actor(actors: Column) -> Column:
    """The best actor's points, by name or else by alias; an unknown actor has 15."""
    names = {k: v[0] for k, v in dims.KNOWN_ACTORS.items()}
    aliases = {a: v[0] for v in dims.KNOWN_ACTORS.values() for a in v[1]}
    points = F.transform(actors, lambda a: F.coalesce(T.lookup(names, a), T.lookup(aliases, a), F.lit(dims.UNKNOWN_ACTOR)))
    return F.least(F.coalesce(F.array_max(points), F.lit(0)), F.lit(30))


def attribution(points: Column) -> Column:
    return F.when(points >= 25, "confirmed").when(points >= 15, "suspected").when(points > 0, "possible").otherwise("none")


def tactics_of(techniques: Column) -> Column:
    """The ordinal of the first tactic whose name or id occurs in each technique (any case); -1 for none."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n.lower()).alias("name"), F.lit(t[0].lower()).alias("id")) for i, (n, t) in enumerate(dims.TACTICS.items())])

    def first(technique: Column) -> Column:
        hits = T.let(F.lower(technique), lambda low: F.filter(table, lambda t: F.contains(low, t["name"]) | F.contains(low, t["id"])))
        return F.coalesce(F.try_element_at(hits, F.lit(1))["i"], F.lit(-1))

    return F.transform(techniques, first)


def mitre(ordinals: Column) -> Column:
    """From `tactics_of`: each tactic's points once, 3 for every technique without a tactic, at most 20."""
    points = T.literals([p for _, p in dims.TACTICS.values()])
    known = F.transform(F.filter(F.array_distinct(ordinals), lambda o: o >= 0), lambda o: F.get(points, o))
    generic = F.size(F.filter(ordinals, lambda o: o < 0)) * 3
    return F.least(F.coalesce(total(known) + generic, F.lit(0)), F.lit(20))


def sophistication(ordinals: Column) -> Column:
    n = F.size(F.filter(F.array_distinct(ordinals), lambda o: o >= 0))
    return F.when(n >= 5, "advanced").when(n >= 3, "intermediate").when(n >= 1, "basic").otherwise("none")


def confidence_bonus(value: Column) -> Column:
    v = F.coalesce(value, F.lit(0.5))
    return F.when(v >= 0.9, 10).when(v >= 0.8, 7).when(v >= 0.6, 3).otherwise(0)


def normalized(points: Column) -> Column:
    """At most 100: what exceeds 100 counts three tenths above 70."""
    over = F.least(F.lit(100.0), F.lit(70.0) + (points - 100).cast("double") * 0.3)
    return F.when(points > 100, over.cast("int")).otherwise(F.greatest(points, F.lit(0)))


def decay_factor(days: Column) -> Column:
    return F.when(days.isNull() | (days <= 7), 1.0).when(days <= 30, 0.9).when(days <= 90, 0.75).when(days <= 180, 0.6).otherwise(0.5)


def decayed(score: Column, days: Column) -> Column:
    return (score * decay_factor(days)).cast("int")


FACTORS = ["cross_source", "source_quality", "keywords", "entropy", "geo_risk", "domain_age", "threat_type_severity", "threat_actor", "mitre_techniques", "ai_confidence"]


def top_factors(k: int = 5, names=FACTORS) -> Column:
    """The k largest factors with points, larger first, ties in factor order, as structs of factor and score."""
    table = ", ".join(f"struct(-`{n}` as key, {i} as i, '{n}' as factor, `{n}` as score)" for i, n in enumerate(names))
    return F.expr(f"transform(filter(slice(sort_array(array({table})), 1, {k}), x -> x.score > 0), x -> struct(x.factor as factor, x.score as score))")


# Sectors


def sector_match(text: Column, value: Column, kind: Column, actors: Column, title: Column | None = None, tags: Column | None = None) -> Column:
    """The best sector as a struct (score, -ordinal, sector, bonus); the first on ties.

    A tenth a keyword (in the text, the title or a tag) up to .4, .15 a domain pattern up to .3, .15 an actor up to .3.
    """
    if title is not None or tags is not None:
        text = F.concat_ws(" ", F.lit(None).cast("string") if title is None else title, text, F.lit(None).cast("string") if tags is None else F.array_join(tags, " "))
    low, value = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(value, F.lit("")))
    names = F.concat(F.lit("\n"), F.array_join(F.coalesce(F.transform(actors, F.trim), T.literals([])), "\n\n"), F.lit("\n"))

    def best(x: Column) -> Column:
        out = []
        for i, (name, (bonus, keys, patterns, known)) in enumerate(dims.SECTORS.items()):
            by_key = F.least(T.count_hits(x["low"], keys) * 0.1, F.lit(0.4))
            by_domain = F.when(kind.isin("domain", "url", "hostname"), F.least(T.count_hits(x["value"], patterns) * 0.15, F.lit(0.3))).otherwise(0.0)
            by_actor = F.least(F.regexp_count(x["names"], F.lit("\n(" + "|".join(known) + ")\n")) * 0.15, F.lit(0.3))
            out.append(F.struct((by_key + by_domain + by_actor).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("sector"), F.lit(bonus).alias("bonus")))
        return F.greatest(*out)

    return T.let(F.struct(low.alias("low"), value.alias("value"), names.alias("names")), best)


def sector_result(best: Column) -> Column:
    """The struct (sector, confidence, bonus) of `sector_match`; general without any match."""
    general = F.struct(F.lit("general").alias("sector"), F.lit(0.0).alias("confidence"), F.lit(0).alias("bonus"))
    return F.when(best["score"] > 0, F.struct(best["sector"].alias("sector"), F.round(F.least(best["score"], F.lit(1.0)), 2).alias("confidence"), best["bonus"].alias("bonus"))).otherwise(general)


def sector_first(text: Column, actors: Column) -> Column:
    """The first sector with a keyword in the text or one of its actors (any case); else general."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names = F.coalesce(F.transform(actors, F.lower), T.literals([]))
    out = F.when(F.lit(False), "")
    for name, (keys, known) in dims.SECTORS_REDUCED.items():
        out = out.when(T.contains_any(low, keys) | F.arrays_overlap(names, T.literals([x.lower() for x in known])), name)
    return out.otherwise("general")


def threat_level(critical: Column, high: Column, medium: Column, low: Column, n: Column) -> Column:
    level = (critical * 4 + high * 3 + medium * 2 + low) / n
    return F.when(level >= 3.5, "critical").when(level >= 2.5, "high").when(level >= 1.5, "medium").when(level > 0, "low").otherwise("clean")
