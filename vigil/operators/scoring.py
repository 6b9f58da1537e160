"""The risk scorers: service (per event), grouped, typed and legacy (per indicator), and the classifiers' rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scores as S
from ..functions import text as T

KEY = ["ioc_type", "ioc_value"]


def service_score(events: DataFrame) -> DataFrame:
    """`events` with the ten factors, `risk_score`, `severity_ai`, `sector` and the breakdown's summary.

    Needs ioc_type, ioc_value, description, sources, country_code, domain_age_days, ioc_age_days,
    threat_types, actors, techniques, ai_confidence. What several expressions use is a column first, so that
    it is computed once.
    """
    kind, text = F.col("ioc_type"), F.col("description")
    shared = {"_entropy": S.entropy_value(F.col("ioc_value"), kind), "_tactics": S.tactics_of(F.col("techniques")), "_sector": S.sector_match(text, F.col("ioc_value"), kind, F.col("actors"))}
    factors = {
        "cross_source": S.cross_source(F.col("sources")), "source_quality": S.source_quality(F.col("sources")), "keywords": S.keywords(text),
        "entropy": S.entropy_points(F.col("_entropy")), "geo_risk": S.geo_risk(F.col("country_code")), "domain_age": S.domain_age(F.col("domain_age_days"), kind),
        "threat_type_severity": S.threat_type(F.col("threat_types")), "threat_actor": S.actor(F.col("actors")), "mitre_techniques": S.mitre(F.col("_tactics")),
        "ai_confidence": S.confidence_bonus(F.col("ai_confidence")), "sector_result": S.sector_result(F.col("_sector")),
    }
    traditional = sum((F.col(n) for n in S.FACTORS[1:6]), F.col(S.FACTORS[0]))
    ai = sum((F.col(n) for n in S.FACTORS[7:]), F.col(S.FACTORS[6]))
    out = events.withColumns(shared).withColumns(factors).withColumns({"traditional_score": traditional, "ai_score": ai})
    out = out.withColumn("raw_total", F.col("traditional_score") + F.col("ai_score")).withColumn("original_score", S.normalized(F.col("raw_total")))
    out = out.withColumn("decayed_score", S.decayed(F.col("original_score"), F.col("ioc_age_days")))
    out = out.withColumns({"sector": F.col("sector_result.sector"), "sector_confidence": F.col("sector_result.confidence"), "sector_bonus": F.col("sector_result.bonus")})
    out = out.withColumn("risk_score", F.least(F.col("decayed_score") + F.col("sector_bonus"), F.lit(100))).withColumn("severity_ai", T.service_band(F.col("risk_score")))
    primary = F.coalesce(F.get("threat_types", F.lit(0)), F.lit("Unknown"))
    summary = {"top_factors": S.top_factors(), "has_actor": F.size("actors") > 0, "has_mitre": F.size("techniques") > 0, "primary_threat": primary}
    return out.withColumns(summary).withColumn("severity_th", T.lookup(dims.SEVERITY_TH, F.col("severity_ai"))).drop("sector_result", *shared)


def _group(events: DataFrame) -> DataFrame:
    """One row for each indicator: what the grouped scorers need, gathered in one shuffle.

    Keyword and word lists are matched per event and merged as sets, so that no group's texts are
    concatenated; a keyword never spans two events' texts.
    """
    severity = F.when(F.col("severity") == "critical", 15).when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).otherwise(0)
    low = F.lower(F.coalesce("description", F.lit("")))
    words = [*dims.DASHBOARD_KEYWORDS, *[w for w in dims.HASH_WORDS if w not in dims.DASHBOARD_KEYWORDS]]
    cve = F.when(F.lit(False), 0)
    for points, signs in dims.CVE_BANDS:
        cve = cve.when(T.contains_any(low, signs), points)
    # the registrant's and the network's names come with enrichment
    names = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("registrant", "network")]
    rows = events.select(*KEY, "source_name", "threat_types", "event_time", "event_id", "domain_age_days", "country_code", "confidence", *names, severity.alias("sev"), *[F.contains(low, F.lit(w)).alias(f"has {w}") for w in words], cve.otherwise(0).alias("cve"), F.col("severity").alias("severity_in"))
    first = F.struct("event_time", "event_id", "domain_age_days", "country_code", "registrant", "network")
    rank = F.array_position(T.literals(dims.SEVERITIES), F.col("severity_in"))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n_events"), F.sort_array(F.collect_set("source_name")).alias("sources"), F.sum(F.size("threat_types")).alias("n_types"),
        F.min(first).alias("first"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.max("sev").alias("source_severity"),
        F.max(rank).alias("max_rank"), F.avg("confidence").alias("avg_confidence"), F.max("cve").alias("cve_points"), F.bool_or(F.col("severity_in") == "critical").alias("any_critical"), F.bool_or(F.col("severity_in") == "high").alias("any_high"),
        *[F.bool_or(F.col(f"has {k}")).cast("int").alias(f"kw_{i}") for i, k in enumerate(dims.DASHBOARD_KEYWORDS)],
        *[F.bool_or(F.col(f"has {k}")).cast("int").alias(f"hw_{i}") for i, k in enumerate(dims.HASH_WORDS)],
    )


def _sum(prefix: str, words: list) -> Column:
    return sum((F.col(f"{prefix}_{i}") for i in range(1, len(words))), F.col(f"{prefix}_0"))


def grouped_score(events: DataFrame) -> DataFrame:
    """Per indicator: points by source class, threat types, kind-specific signs, entropy, keywords and the sources' worst severity.

    A domain's or url's signs are its age and a registrant who hides, an address's the kind of its network, as the first event has them.
    """
    g = _group(events).withColumn("keywords_found", _sum("kw", dims.DASHBOARD_KEYWORDS))
    classes = F.transform("sources", T.source_class)
    n = lambda c: F.size(F.filter(classes, lambda x: x == c))
    cap = lambda value, most: F.least(value, F.lit(most))
    cross = cap(cap(n("threat_intel") * 15, 30) + cap(n("sandbox") * 10, 10) + cap(n("security_tool") * 10, 10) + cap(n("evidence") * 8, 16) + cap(n("other") * 5, 10), 40)
    days = F.col("first.domain_age_days")
    age = F.when(days <= 30, 20).when(days <= 90, 15).when(days <= 180, 8).otherwise(0) + whois_privacy_points(F.col("first.registrant"))
    signs = F.when(F.col("ioc_type").isin("domain", "url"), age).when(F.col("ioc_type") == "ip", network_points(F.col("first.network"))).otherwise(0)
    e = T.entropy_full(F.substring_index(F.substring_index("ioc_value", "/", 1), ":", 1))
    entropy = F.when(F.col("ioc_type").isin("domain", "url", "hostname"), F.when(e > 4.0, 12).when(e > 3.5, 8).when(e > 3.0, 4).otherwise(0)).otherwise(0)
    found = F.col("keywords_found")
    parts = {
        "cross_source": cross, "threat_type": F.when(F.col("n_types") >= 2, 10).when(F.col("n_types") >= 1, 5).otherwise(0), "type_specific": signs, "entropy": entropy,
        "keywords": F.when(found >= 4, 20).when(found >= 2, 12).when(found >= 1, 6).otherwise(0), "source_severity": F.col("source_severity"),
    }
    out = g.withColumns(parts)
    out = out.withColumn("risk_score", sum((F.col(c) for c in list(parts)[1:]), F.col("cross_source"))).withColumn("severity", T.dashboard_band(F.col("risk_score")))
    return out.select(*KEY, "n_events", "sources", "first_seen", "last_seen", "keywords_found", *parts, "risk_score", "severity")


def write_back(events: DataFrame, scores: DataFrame) -> DataFrame:
    """`events` with their indicator's `risk_score`, `severity_ai` and `breakdown` from `scores` (one row each), null where it has none.

    Scores are gathered per indicator, so a hot one meets its events in a join that Spark may split, not in a window.
    """
    parts = F.struct("cross_source", "threat_type", "type_specific", "entropy", "keywords", "source_severity").alias("breakdown")
    return events.drop("risk_score", "severity_ai", "breakdown").join(scores.select(*KEY, "risk_score", F.col("severity").alias("severity_ai"), parts), KEY, "left")


def whois_privacy_points(registrant: Column) -> Column:
    return F.when(T.contains_any(F.lower(F.coalesce(registrant, F.lit(""))), dims.PRIVACY_WORDS), 5).otherwise(0)


def network_points(org: Column) -> Column:
    """Hosting words are tried before bulletproof and VPN words."""
    low = F.lower(F.coalesce(org, F.lit("")))
    return F.when(T.contains_any(low, dims.HOSTING_WORDS), 10).when(T.contains_any(low, dims.BULLET_WORDS), 15).otherwise(0)


def typed_score(events: DataFrame) -> DataFrame:
    """Per indicator: sources, one sign by kind (domain age, country, malware words, CVE wording), entropy of domains, keywords."""
    g = _group(events)
    n, kind, days = F.size("sources"), F.col("ioc_type"), F.col("first.domain_age_days")
    words, found = _sum("hw", dims.HASH_WORDS), _sum("kw", dims.DASHBOARD_KEYWORDS)
    special = (
        F.when(kind.isin("domain", "url"), F.when(days < 30, 25).when(days < 90, 15).when(days < 365, 5).otherwise(0))
        .when(kind == "ip", F.when(F.col("first.country_code").isin(dims.HIGH_RISK_COUNTRIES[:5]), 25).otherwise(0))
        .when(kind.isin("sha256", "sha1", "md5"), F.when(words >= 2, 25).when(words == 1, 15).otherwise(0))
        .when(kind == "cve", F.col("cve_points"))
        .otherwise(0)
    )
    e = T.entropy_full(F.substring_index("ioc_value", ".", 1))
    parts = {
        "cross_source": F.when(n == 1, 20).otherwise(F.least(n * 15, F.lit(40))), "type_specific": special,
        "entropy": F.when(kind == "domain", F.when(e > 4.0, 20).when(e > 3.5, 10).when(e > 3.0, 5).otherwise(0)).otherwise(0), "keywords": F.when(found >= 3, 15).when(found >= 1, 8).otherwise(0),
    }
    out = g.withColumns(parts).withColumn("risk_score", F.col("cross_source") + F.col("type_specific") + F.col("entropy") + F.col("keywords"))
    return out.withColumn("severity", T.dashboard_band(F.col("risk_score"))).select(*KEY, *parts, "risk_score", "severity")


def legacy_score(events: DataFrame) -> DataFrame:
    """Per indicator: 50 points for one source, 100 for more; a worst severity of critical adds 25 below 100, of high 15 below 75."""
    g = _group(events)
    base = F.when(F.size("sources") >= 2, 100).when(F.size("sources") == 1, 50).otherwise(0)
    lifted = F.col("any_critical") & (F.col("base") < 100)
    score = F.when(lifted, F.least(F.col("base") + 25, F.lit(100))).when(~F.col("any_critical") & F.col("any_high") & (F.col("base") < 75), F.col("base") + 15).otherwise(F.col("base"))
    level = F.when(lifted, "critical").when(F.size("sources") >= 2, "high").when(F.size("sources") == 1, "medium").otherwise("clean")
    return g.withColumn("base", base).select(*KEY, score.alias("risk_score"), level.alias("severity"))


def indicator_profile(events: DataFrame) -> DataFrame:
    """Per indicator: events, distinct sources, first and last sighting, worst severity, confidence with boosts."""
    g = _group(events)
    worst = F.get(T.literals(dims.SEVERITIES), F.greatest(F.col("max_rank").cast("int") - 1, F.lit(0)))
    boosted = F.least(F.col("avg_confidence") + F.least(F.size("sources") * 10, F.lit(30)) + F.when(F.col("first.domain_age_days").isNotNull(), 10).otherwise(0), F.lit(100.0))
    return g.select(*KEY, "n_events", F.size("sources").alias("n_sources"), "sources", "first_seen", "last_seen", worst.alias("max_severity"), F.round(boosted, 4).alias("confidence"))


def cross_source_boost(scored: DataFrame, distinct_sources: bool = False) -> DataFrame:
    """`scored` with `boosted`: an indicator seen in several records (or sources) gains 10 points each, at most 40, up to 100.

    The count is pre-aggregated and joined back, so a hot indicator makes no large window.
    """
    n = F.count_distinct("source_name") if distinct_sources else F.count("*")
    counts = scored.groupBy(*KEY).agg(n.alias("seen_in"))
    gain = F.when(F.col("seen_in") > 1, F.least(F.col("seen_in") * 10, F.lit(40))).otherwise(0)
    return scored.join(counts, KEY).withColumn("boosted", F.least(F.col("risk_score") + gain, F.lit(100)))


def classify_lexicon(rows: DataFrame, text_col: str = "description", threshold: float = 0.3) -> DataFrame:
    """`rows` with `labels`: (label, score) by descending score, `predicted_types` and `predicted_confidence`.

    The offline stand-in for a neural zero-shot model: a label's score is 0.3 and 0.2 more for each further
    cue word, up to 1; texts under 10 characters have none.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    scored = []
    for i, (label, cues) in enumerate(dims.LEXICON.items()):
        hits = T.count_hits(low, cues) if cues else F.lit(0)
        scored.append(F.struct((-F.when(hits > 0, F.least(F.lit(1.0), hits * 0.2 + 0.1)).otherwise(0.0)).alias("key"), F.lit(i).alias("i"), F.lit(label).alias("label")))
    kept = F.filter(F.sort_array(F.array(*scored)), lambda x: -x["key"] >= threshold - 1e-9)
    labels = F.when(F.length(low) >= 10, kept).otherwise(F.filter(kept, lambda x: F.lit(False)))
    out = rows.withColumn("labels", F.transform(labels, lambda x: F.struct(x["label"].alias("label"), F.round(-x["key"], 3).alias("score"))))
    return out.withColumns({"predicted_types": F.transform("labels", lambda x: x["label"]), "predicted_confidence": F.coalesce(F.try_element_at("labels", F.lit(1))["score"], F.lit(0.0))})


def classify_activity(rows: DataFrame, index_col: str = "source_index", activity_col: str = "detected_activity") -> DataFrame:
    """`rows` with `rule_types` and `rule_confidence` where the row comes from an activity feed; else null."""
    key = T.activity_key(F.col(activity_col))
    mapped = F.coalesce(T.lookup(dims.ACTIVITIES, key), F.nullif(F.col(activity_col), F.lit("")), F.lit("Unknown"))
    feed = F.startswith(F.col(index_col), F.lit("cyberint-feeds"))
    return rows.withColumns({"rule_types": F.when(feed, F.array(mapped)), "rule_confidence": F.when(feed, 1.0)})


def analyzed(rows: DataFrame, json_col: str) -> DataFrame:
    """Post-processing of a language model's JSON analysis: `verdict` with clamped numbers, a known severity and defaults; null where it isn't JSON.

    A confidence that is missing or 0 counts as 50.
    """
    raw = F.from_json(F.col(json_col), "severity string, confidence double, threatActors array<string>, mitreTechniques array<string>, threatCategory string, summary string, recommendedActions array<string>, aiScore double")
    clamped = lambda x, default: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))))
    verdict = F.struct(
        T.severity_analyzed(raw["severity"]).alias("severity"), clamped(raw["confidence"], 50.0).alias("confidence"), F.coalesce(raw["threatActors"], T.literals([])).alias("actors"),
        F.coalesce(raw["mitreTechniques"], T.literals([])).alias("techniques"), F.coalesce(F.nullif(raw["threatCategory"], F.lit("")), F.lit("other")).alias("category"),
        F.coalesce(raw["summary"], F.lit("")).alias("summary"), F.coalesce(raw["recommendedActions"], T.literals([])).alias("actions"), clamped(raw["aiScore"], 0.0).alias("score"),
    )
    return rows.withColumn("verdict", F.when(F.try_parse_json(F.col(json_col)).isNotNull(), verdict))


def neural_classifier(predict, batch_size: int = 16):
    """A pandas UDF over text for a model: `predict` maps a list of at most `batch_size` texts to lists of (label, score).

    If a batch fails, or gives another number of results, its texts are tried one by one; one that fails alone has no labels.
    """

    def tried(texts: list[str]) -> list:
        try:
            found = list(predict(texts))
            if len(found) == len(texts):
                return found
        except Exception:  # whatever the model raises
            pass
        return [[]] if len(texts) == 1 else [r for t in texts for r in tried([t])]

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            found = [r for i in range(0, len(values), batch_size) for r in tried(values[i : i + batch_size])]
            yield pd.Series([[{"label": n, "score": float(s)} for n, s in sorted(r, key=lambda x: -x[1])] for r in found])

    return classify
