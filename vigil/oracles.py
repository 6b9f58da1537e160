"""The queries' results as DuckDB SQL over the same tables, written from the rules, not from the operators."""

from __future__ import annotations

from . import dims


def q(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(q, x)) + "]" + ("::varchar[]" if not x else "")
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def any_in(words, text: str) -> str:
    return "(" + " or ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def hits(words, text: str) -> str:
    return f"list_filter({q(list(words))}, lambda k: contains({text}, k))"


def pairs(mapping: dict) -> str:
    return "[" + ", ".join(f"{{'k': {q(k)}, 'v': {q(v)}}}" for k, v in mapping.items()) + "]"


def found(mapping: dict, key: str) -> str:
    return f"list_filter({pairs(mapping)}, lambda p: p.k = {key})[1].v"


TIER = f"case when {any_in([s.upper() for s in dims.TRUSTED_SOURCES], 'upper(s)')} then 15 when {any_in([s.upper() for s in dims.NEWS_SOURCES], 'upper(s)')} then 8 else 5 end"
ACTORS = "[" + ", ".join(f"{{'n': {q(n)}, 'c': {q([x.lower() for x in (n, *al)])}}}" for n, al in dims.TEXT_ACTORS.items()) + "]"
CLASS = "case " + " ".join(f"when {any_in([x.lower() for x in v], 'lower(s)')} then '{k}'" for k, v in dims.SOURCE_CLASSES.items()) + f" when {any_in(dims.EVIDENCE_WORDS, 'lower(s)')} then 'evidence' else 'other' end"

TE = f"""
e0 as (select *, md5(user_id::varchar) as h, ((event_id * 7 + user_id) % 16)::int as tmpl, {q(dims.EVENT_SOURCES)} as names from events),
e1 as (select event_id, user_id, event_type, tmpl, ts::timestamp as event_time,
  (['domain', 'ip', 'url', 'sha256', 'sha1', 'md5', 'cve'])[event_id % 7 + 1] as ioc_type,
  case event_id % 7 when 0 then substr(h, 1, (4 + user_id % 12)::int) || '.example.com'
    when 1 then '10.' || (user_id % 256) || '.' || (user_id % 7) || '.' || (user_id % 250)
    when 2 then 'https://' || substr(h, 1, 8) || '.example.net/p/' || user_id
    when 3 then h || h when 4 then h || substr(h, 1, 8) when 5 then h
    else 'CVE-2024-' || lpad(user_id::varchar, 4, '0') end as ioc_value,
  names[(event_id + user_id) % 12 + 1] as source_name,
  list_transform(range(0, 1 + event_id % 4), lambda i: names[(event_id + user_id + i) % 12 + 1]) as sources,
  case event_type when 'error' then 'Very High' when 'purchase' then 'high' when 'click' then ' Medium ' when 'view' then 'low' else '' end as severity_raw,
  floor(value)::int as confidence_raw,
  ({q([t for t, _, _ in dims.TEMPLATES])})[tmpl + 1] as description,
  ({q([t for _, t, _ in dims.TEMPLATES])})[tmpl + 1] as threat_types,
  ({q([c for _, _, c in dims.TEMPLATES])})[tmpl + 1]::double as ai_confidence,
  case when user_id % 5 <> 0 then (user_id * 13) % 500 end as domain_age_days,
  case when event_id % 11 <> 0 then event_id % 250 end as ioc_age_days,
  ({q(dims.EVENT_COUNTRIES)})[user_id % 9 + 1] as country_code,
  [event_type, 'tmpl-' || tmpl] as tags, ({q(dims.EVENT_REGISTRANTS)})[user_id % 4 + 1] as registrant, ({q(dims.EVENT_NETWORKS)})[user_id % 5 + 1] as network,
  'https://www.' || ({q(list(dims.NEWS_SITES))})[event_id % 3 + 1] || '/2024/' || (['big-breach', 'zero_day-patch', 'index'])[user_id % 3 + 1] || case when user_id % 2 = 0 then '.html' else '' end as reference
  from e0),
te as (select *, lower(description) as low,
  case lower(trim(severity_raw)) when 'very high' then 'critical' when 'high' then 'high' when 'medium' then 'medium' else 'low' end as severity,
  least(greatest(confidence_raw, 0), 100) as confidence,
  list_transform(list_filter({ACTORS}, lambda a: len(list_filter(a.c, lambda c: contains(lower(description), c))) > 0), lambda a: a.n) as actors,
  list_transform(regexp_extract_all(description, '(?i)\\bT\\d{{4}}(?:\\.\\d{{3}})?\\b'), lambda t: upper(t)) as techniques
  from e1)"""


def entropy(text: str, places: int) -> str:
    return f"round(coalesce(list_entropy(string_split({text}, '')), 0), {places})"


LABEL = "regexp_replace(lower(split_part(ioc_value, '.', 1)), '[^a-z0-9]', '', 'g')"
KNOWN = {k: v[0] for k, v in dims.KNOWN_ACTORS.items()}
ALIAS = {a: v[0] for v in dims.KNOWN_ACTORS.values() for a in v[1]}
POINTS = {k: v[1] for k, v in dims.THREAT_TYPES.items()}
LEVEL = {k: v[0] for k, v in dims.THREAT_TYPES.items()}
SITES = "ioc_type in ('domain', 'url', 'hostname')"

CROSS = "case len(list_distinct(sources)) when 0 then 0 when 1 then 5 when 2 then 15 when 3 then 25 else least(30 + 5 * (len(list_distinct(sources)) - 3), 40) end"
QUALITY = f"least(list_sum(list_transform(sources, lambda s: {TIER})), 40)"
AGE = f"case when {SITES} then case when domain_age_days < 30 then 20 when domain_age_days < 90 then 15 when domain_age_days < 180 then 10 when domain_age_days < 365 then 5 else 0 end else 0 end"
TYPE = f"coalesce(least(least(coalesce(list_sum(list_transform(threat_types[1:2], lambda t: coalesce({found(POINTS, 't')}, 3))), 0), 30) + case when len(threat_types) >= 3 then 5 else 0 end, 35), 0)"
ACTOR = f"least(coalesce(list_max(list_transform(actors, lambda a: coalesce({found(KNOWN, 'a')}, {found(ALIAS, 'a')}, 15))), 0), 30)"
MITRE = "least(3 * len(techniques), 20)"
BONUS = "case when ai_confidence >= 0.9 then 10 when ai_confidence >= 0.8 then 7 when ai_confidence >= 0.6 then 3 else 0 end"
DECAY = "case when ioc_age_days is null or ioc_age_days <= 7 then 1.0 when ioc_age_days <= 30 then 0.9 when ioc_age_days <= 90 then 0.75 when ioc_age_days <= 180 then 0.6 else 0.5 end::double"
BAND = "case when {0} >= 75 then 'critical' when {0} >= 50 then 'high' when {0} >= 25 then 'medium' when {0} > 0 then 'low' else 'clean' end"
DBAND = "case when {0} >= 45 then 'critical' when {0} >= 30 then 'high' when {0} >= 15 then 'medium' when {0} >= 6 then 'low' else 'clean' end"


def sector_structs() -> str:
    out = []
    for i, (name, (bonus, keys, patterns, names)) in enumerate(dims.SECTORS.items()):
        key = f"least(len({hits(keys, 'low')}) * 0.1::double, 0.4::double)"
        domain = f"case when {SITES} then least(len({hits(patterns, 'lower(ioc_value)')}) * 0.15::double, 0.3::double) else 0::double end"
        actor = f"least(len(list_filter(actors, lambda a: list_contains({q(names)}, a))) * 0.15::double, 0.3::double)"
        out.append(f"{{'s': {key} + {domain} + {actor}, 'r': {-i}, 'n': '{name}', 'b': {bonus}}}")
    return "list_reverse_sort([" + ", ".join(out) + "])[1]"


FLAG = f"""{TE},
f as (select *, {CROSS} as cross_source, {QUALITY} as source_quality, least(5 * len({hits(dims.SERVICE_KEYWORDS, 'low')}), 25) as keywords,
  {entropy(LABEL, 3)} as ent, 0 as geo_risk, {AGE} as domain_age, {TYPE} as threat_type_severity, {ACTOR} as threat_actor, {MITRE} as mitre_techniques, {BONUS} as ai_confidence_points, {sector_structs()} as sec from te),
g as (select *, case when {SITES} then case when ent > 4.0 then 15 when ent > 3.5 then 10 when ent > 3.0 then 5 else 0 end else 0 end as entropy from f),
t as (select *, cross_source + source_quality + keywords + entropy + geo_risk + domain_age as traditional_score, threat_type_severity + threat_actor + mitre_techniques + ai_confidence_points as ai_score from g),
o as (select *, case when traditional_score + ai_score > 100 then trunc(least(100::double, 70::double + (traditional_score + ai_score - 100)::double * 0.3::double))::int else traditional_score + ai_score end as original_score from t),
d as (select *, trunc(original_score * {DECAY})::int as decayed_score, case when sec.s > 0 then sec.n else 'general' end as sector, case when sec.s > 0 then round(least(sec.s, 1.0::double), 2) else 0::double end as sector_confidence, case when sec.s > 0 then sec.b else 0 end as sector_bonus from o),
r as (select *, least(decayed_score + sector_bonus, 100) as risk_score from d),
flag as (select event_id, ioc_type, ioc_value, source_name, event_time, threat_types, actors, techniques, description, cross_source, source_quality, keywords, entropy, geo_risk, domain_age, threat_type_severity, threat_actor, mitre_techniques, ai_confidence_points as ai_confidence,
  traditional_score, ai_score, original_score, decayed_score, sector, sector_confidence, sector_bonus, risk_score, {BAND.format('risk_score')} as severity from r)"""

TOP = "array_to_string(list_transform(list_filter((list_sort([" + ", ".join(
    f"{{'k': -{n}, 'i': {i}, 'f': '{n}', 's': {n}}}" for i, n in enumerate(["cross_source", "source_quality", "keywords", "entropy", "geo_risk", "domain_age", "threat_type_severity", "threat_actor", "mitre_techniques", "ai_confidence"])
) + "]))[1:5], lambda x: x.s > 0), lambda x: x.f || ':' || x.s), ',')"

# Indicators: all words matched over every event of the indicator.
DKW, HKW = dims.DASHBOARD_KEYWORDS, dims.HASH_WORDS
GROUP = f"""{TE},
grp as (select ioc_type, ioc_value, count(*) as n_events, list_sort(list(distinct source_name)) as sources, sum(len(threat_types)) as n_types, min(event_time) as first_seen, max(event_time) as last_seen,
  arg_min({{'d': domain_age_days, 'c': country_code, 'r': registrant, 'w': network}}, {{'t': event_time, 'e': event_id}}) as fst, max(case severity when 'critical' then 15 when 'high' then 10 when 'medium' then 5 else 0 end) as source_severity,
  max(list_position({q(dims.SEVERITIES)}, severity)) as worst, avg(confidence) as avg_confidence, bool_or(severity = 'critical') as crit, bool_or(severity = 'high') as high,
  max({"case " + " ".join(f"when {any_in(w, 'low')} then {p}" for p, w in dims.CVE_BANDS) + " else 0 end"}) as cve,
  {" + ".join(f"bool_or(contains(low, {q(k)}))::int" for k in DKW)} as kw, {" + ".join(f"bool_or(contains(low, {q(k)}))::int" for k in HKW)} as hw
  from te group by all)"""


def classes(name: str) -> str:
    return f"len(list_filter(sources, lambda s: {CLASS} = '{name}'))"


GROUPED = f"""with {GROUP},
p as (select *, least(least({classes('threat_intel')} * 15, 30) + least({classes('sandbox')} * 10, 10) + least({classes('security_tool')} * 10, 10) + least({classes('evidence')} * 8, 16) + least({classes('other')} * 5, 10), 40) as cross_source,
  case when n_types >= 2 then 10 when n_types >= 1 then 5 else 0 end as threat_type,
  case when ioc_type in ('domain', 'url') then case when fst.d <= 30 then 20 when fst.d <= 90 then 15 when fst.d <= 180 then 8 else 0 end
      + case when {any_in(dims.PRIVACY_WORDS, "coalesce(lower(fst.r), '')")} then 5 else 0 end
    when ioc_type = 'ip' then case when {any_in(dims.HOSTING_WORDS, "coalesce(lower(fst.w), '')")} then 10 when {any_in(dims.BULLET_WORDS, "coalesce(lower(fst.w), '')")} then 15 else 0 end else 0 end as type_specific,
  {entropy("split_part(split_part(lower(ioc_value), '/', 1), ':', 1)", 2)} as ent,
  case when kw >= 4 then 20 when kw >= 2 then 12 when kw >= 1 then 6 else 0 end as keywords from grp),
z as (select *, case when {SITES} then case when ent > 4.0 then 12 when ent > 3.5 then 8 when ent > 3.0 then 4 else 0 end else 0 end as entropy from p),
s as (select *, cross_source + threat_type + type_specific + entropy + keywords + source_severity as risk_score from z)
select ioc_type, ioc_value, n_events, array_to_string(sources, ',') as sources, strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') as last_seen,
  cross_source, threat_type, type_specific, entropy, keywords, source_severity, risk_score, {DBAND.format('risk_score')} as severity from s"""

TYPED = f"""with {GROUP},
p as (select *, case when len(sources) = 1 then 20 else least(len(sources) * 15, 40) end as cross_source,
  case when ioc_type in ('domain', 'url') then case when fst.d < 30 then 25 when fst.d < 90 then 15 when fst.d < 365 then 5 else 0 end
    when ioc_type = 'ip' then case when fst.c in ('RU', 'CN', 'KP', 'IR', 'BY') then 25 else 0 end
    when ioc_type in ('sha256', 'sha1', 'md5') then case when hw >= 2 then 25 when hw = 1 then 15 else 0 end when ioc_type = 'cve' then cve else 0 end as type_specific,
  {entropy("split_part(lower(ioc_value), '.', 1)", 2)} as ent, case when kw >= 3 then 15 when kw >= 1 then 8 else 0 end as keywords from grp),
z as (select *, case when ioc_type = 'domain' then case when ent > 4.0 then 20 when ent > 3.5 then 10 when ent > 3.0 then 5 else 0 end else 0 end as entropy from p),
s as (select *, cross_source + type_specific + entropy + keywords as risk_score from z)
select ioc_type, ioc_value, cross_source, type_specific, entropy, keywords, risk_score, {DBAND.format('risk_score')} as severity from s"""

LEGACY = f"""with {GROUP}, b as (select *, case when len(sources) >= 2 then 100 when len(sources) = 1 then 50 else 0 end as base from grp)
select ioc_type, ioc_value, case when crit and base < 100 then least(base + 25, 100) when high and not crit and base < 75 then base + 15 else base end as risk_score,
  case when crit and base < 100 then 'critical' when base = 100 then 'high' else 'medium' end as severity from b"""


def first_sector() -> str:
    return "case " + " ".join(
        f"when {any_in(keys, 'low')} or len(list_filter(actors, lambda a: list_contains({q([x.lower() for x in names])}, lower(a)))) > 0 then '{s}'" for s, (keys, names) in dims.SECTORS_REDUCED.items()
    ) + " else 'general' end"


SUMMARY = f"""with {TE}, s as (select *, {first_sector()} as sector from te),
base as (select sector, count(*) as n, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from s group by sector),
ty as (select sector, t, count(*) as m from (select sector, unnest(threat_types) as t from s) group by all),
rk as (select *, row_number() over (partition by sector order by m desc, t) as r from ty),
top as (select sector, string_agg(t || ':' || m, ',' order by r) as top_types from rk where r <= 5 group by sector),
ac as (select sector, array_to_string(list_sort(list(distinct a))[1:5], ',') as actors from (select sector, unnest(actors) as a from s) group by sector)
select sector, n, critical, high, medium, low, case when (critical * 4 + high * 3 + medium * 2 + low) / n >= 3.5 then 'critical' when (critical * 4 + high * 3 + medium * 2 + low) / n >= 2.5 then 'high'
  when (critical * 4 + high * 3 + medium * 2 + low) / n >= 1.5 then 'medium' when critical + high + medium + low > 0 then 'low' else 'clean' end as threat_level, coalesce(top_types, '') as top_types, coalesce(actors, '') as actors
from base left join top using (sector) left join ac using (sector)"""

DAILY = f"{TE}, daily as (select event_time::date as day, t as threat_type, count(*) as n from (select event_time, unnest(case when len(threat_types) > 0 then threat_types else ['Unknown'] end) as t from te) group by all)"

def BM25(terms: str, name: str) -> str:
    """CTEs up to `s_name` (id, s): the sum of BM25 over the terms, from `base` (id, lower-case text)."""
    return f"""w_{name} as (select id, list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') as w from base),
n_{name} as (select count(*) filter (len(w) > 0) as n, avg(nullif(len(w), 0)) as mean from w_{name}),
p_{name} as (select id, t, len(list_filter(w, lambda x: x = t)) as tf, len(w) as l from (select *, unnest({terms}) as t from w_{name}) where list_contains(w, t)),
d_{name} as (select t, count(*) as df from p_{name} group by t),
s_{name} as (select id, sum(round(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf / (tf + 1.2::double * (0.25::double + 0.75::double * l / mean)) * 1e9)::bigint) / 1e9::double as s from p_{name} join d_{name} using (t), n_{name} group by id)"""


#: CTEs up to `found` (id, label, confidence): naive Bayes, from `base` (id, text, label, known).
BAYES = """toks as (select id, label, known, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') as w from base),
shares as (select label, count(*) as n, sum(len(w)) as words, sum(count(*)) over () as total from toks where known and label is not null group by label),
each as (select id, label, known, ('0x' || substr(md5(t), 1, 4))::int as class from (select id, label, known, unnest(w) as t from toks)),
cnt as (select label, class, count(*) as n from each where known group by all),
gains as (select label, class, round(ln(n + 1.0::double) * 1000000)::bigint as gain from cnt),
consts as (select label, round(ln(n::double / total) * 1000000)::bigint as prior, round(-ln((words + 65536)::double) * 1000000)::bigint as least from shares),
sized as (select id, count(*) as n from each group by id),
gained as (select id, g.label, sum(gain) as gain from each e join gains g using (class) group by all),
scores as (select b.id, c.label, prior + least * coalesce(s.n, 0) + coalesce(g.gain, 0) as score from (select distinct id from base) b cross join consts c left join sized s on s.id = b.id left join gained g on g.id = b.id and g.label = c.label),
found as (select id, arg_min(label, (-score, label)) as label, round(1 / sum(exp((score - top)::double / 1000000)), 6) as confidence from (select *, max(score) over (partition by id) as top from scores) group by id)"""


REGRESSION = f"""{DAILY},
days as (select day, row_number() over (order by day) - 1 as x from (select distinct day from daily)),
types as (select threat_type, sum(n) as total from daily group by threat_type having sum(n) >= 3),
series as (select threat_type, x, day, coalesce(n, 0) as n from types cross join days left join daily using (threat_type, day)),
sums as (select threat_type, sum(n)::bigint as total, count(*)::bigint as days, sum(x)::bigint as sx, sum(x * x)::bigint as sxx, sum(x * n)::bigint as sxy, sum(n * n)::bigint as syy from series group by threat_type),
slopes as (select *, total::double / days as mean, case when days * sxx > sx * sx then (days * sxy - sx * total)::double / (days * sxx - sx * sx)::double else 0 end as b, (days * syy - total * total)::double / days as vy, (days * sxy - sx * total)::double / days as cxy from sums),
reg as (select *, case when vy > 0 then greatest(0, 1 - greatest(vy - b * cxy, 0) / vy) else 0 end as r2 from slopes),
trends as (select threat_type, total::bigint as total, days, round(b, 3) + 0.0 as slope, case when b > 0.5 then 'increasing' when b < -0.5 then 'decreasing' else 'stable' end as direction, round(r2, 3) as confidence, round(mean, 1) as current_avg,
  round(greatest(0, b * (days + 6) + mean - b * (sx::double / days)), 1) as prediction_7d, round(b * 7 / mean * 100, 1) + 0.0 as change_percent from reg)"""

SLUG = "regexp_replace(split_part(reference, '/', 5), '\\.html$', '')"
TITLE = f"case when {SLUG} = 'index' then '2024' else array_to_string(list_transform(string_split(regexp_replace({SLUG}, '[-_]', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end"
NEWS = "case when contains(reference, 'thehackernews.com') then 'TheHackerNews' when contains(reference, 'darkreading.com') then 'DarkReading' else 'BleepingComputer' end"
ARTICLES = f"""{TE}, io as (select reference, ioc_type, ioc_value, min(event_id) as seen from te group by all), rk as (select *, row_number() over (partition by reference order by seen) as r from io),
rel as (select reference, string_agg(ioc_type || ':' || ioc_value, ',' order by r) filter (r <= 5) as related, count(*) as ioc_count from rk group by reference),
base as (select reference, min(event_time) as d, min(event_id) as seen, {NEWS} as source, {TITLE} as title from te group by all),
articles as (select 'news-' || (row_number() over (order by seen) - 1) as id, title, reference as url, source, strftime(d, '%Y-%m-%d %H:%M:%S') as date, related, ioc_count from base join rel using (reference))"""

GRAPH = f"""{TE}, ge as (select *, 'ioc:' || ioc_type || ':' || ioc_value as ioc,
  case when user_id % 10 = 0 then ['Night Owl'] else []::varchar[] end as ra, case when user_id % 4 = 0 then ['Dark Rat'] else []::varchar[] end as mf, case when user_id % 6 = 0 then ['Winter Op'] else []::varchar[] end as ca,
  case when user_id % 3 = 0 then list_filter(['d' || (user_id % 50) || '.example.com', ioc_value], lambda d: d <> ioc_value) else []::varchar[] end as rd, case when user_id % 5 = 0 then [md5((user_id % 20)::varchar)] else []::varchar[] end as rh from te {{where}}),
en as (
  select event_id, ioc, 1 as step, ioc as id, case when len(ioc_value) > 30 then substr(ioc_value, 1, 27) || '...' else ioc_value end as label, 'ioc' as type, ioc_type as sub_type, severity, 12 as size, null as link, null as said from ge
  union all select event_id, ioc, 2, 'actor:' || regexp_replace(lower(x), '\\s+', '_', 'g'), x, 'threat_actor', '', '', 15, 'attributed_to', 'attributed to' from (select *, unnest(actors) as x from ge)
  union all select event_id, ioc, 3, 'actor:' || regexp_replace(lower(x), '\\s+', '_', 'g'), x, 'threat_actor', '', '', 15, 'attributed_to', 'attributed to' from (select *, unnest(ra) as x from ge)
  union all select event_id, ioc, 4, 'entity:malware:' || regexp_replace(lower(x), '\\s+', '_', 'g'), x, 'entity', 'malware_family', '', 10, 'related_to', 'uses malware' from (select *, unnest(mf) as x from ge)
  union all select event_id, ioc, 5, 'entity:campaign:' || regexp_replace(lower(x), '\\s+', '_', 'g'), x, 'entity', 'campaign', '', 10, 'related_to', 'part of campaign' from (select *, unnest(ca) as x from ge)
  union all select event_id, ioc, 6, 'ioc:domain:' || x, case when len(x) > 25 then substr(x, 1, 22) || '...' else x end, 'domain', 'domain', '', 8, 'related_to', 'related domain' from (select *, unnest(rd) as x from ge)
  union all select event_id, ioc, 7, 'ioc:hash:' || substr(x, 1, 16), substr(x, 1, 12) || '...', 'ioc', 'hash', '', 8, 'contains', 'contains hash' from (select *, unnest(rh) as x from ge)),
nodes as (select id, label, type, sub_type, severity, size from (select *, row_number() over (partition by id order by event_id, step, label) as r from en) where r = 1),
links as (select source, target, type, label from (select ioc as source, id as target, link as type, said as label, row_number() over (partition by least(ioc, id), greatest(ioc, id), link order by event_id, step, said, ioc) as r from en where link is not null) where r = 1)"""
NODES, STATS = GRAPH.replace("{where}", ""), GRAPH.replace("{where}", "where len(actors) > 0 or user_id % 10 = 0")

COUNTRIES = "cn(code, name, lat, lng) as (values " + ", ".join(f"('{c}', {q(n)}, {a}::double, {b}::double)" for c, (n, a, b) in dims.COUNTRIES.items()) + ")"
GEO = f"""{TE}, {COUNTRIES}, cs as (select country_code as code, severity, count(*) as n from te where country_code <> 'TH' group by all),
geo as (select code, any_value(name) as name, any_value(lat) as lat, any_value(lng) as lng, sum(n)::bigint as n, string_agg(severity || ':' || n, ',' order by severity) as severities, arg_max(severity, list_position({q(dims.SEVERITIES)}, severity)) as primary_severity,
  round(3 + log2(sum(n) + 1) * 1.2, 6) as radius, round(1.5::double + sum(n)::double / max(sum(n)) over () * 4, 6) as stroke from cs join cn using (code) group by code)"""

ALERTS = f"{TE}, al as (select *, row_number() over (order by event_time, event_id) as no from te where severity in ('critical', 'high', 'medium')), alerts as (select 'ALERT-' || case when no < 100000 then lpad(no::varchar, 5, '0') else no::varchar end as alert_id, event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, severity, 'open' as status from al)"
LEXICON = "list_sort([" + ", ".join(f"{{'k': case when len({hits(c, 'low')}) > 0 then -least(1.0::double, len({hits(c, 'low')}) * 0.2::double + 0.1::double) else 0.0::double end, 'i': {i}, 'l': {q(n)}}}" for i, (n, c) in enumerate(dims.LEXICON.items())) + "])"
DAY = "strftime(day, '%Y-%m-%d') as day"
WORDS = ["the", "tion", "er", "und", "que", "los", "heit", "zzz"]
CLEAN = "trim(regexp_replace(regexp_replace(text, '[^ -~]', ' ', 'g'), ' +', ' ', 'g'))"


def top_item(field: str, source: str) -> str:
    return f"select row_number() over (order by n desc, key) as rank, key, n, '{field}' as field from (select key, count(*) as n from ({source}) where key <> '' group by key order by n desc, key limit 5)"


FILE_ORDER = "row_number() over (order by event_time, event_id)"
CSV_LINE = """ioc_type || ',"' || ioc_value || '",' || severity || ',' || confidence || ',' || source_name || ',' || array_to_string(threat_types, ';') || ',' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || ',"' || replace(description, '"', '""') || '"'"""
JSON_LINE = """'{"type":"' || ioc_type || '","value":"' || ioc_value || '","severity":"' || severity || '","confidence":' || confidence || ',"source":"' || source_name || '","threat_type":[' || array_to_string(list_transform(threat_types, lambda t: '"' || t || '"'), ',') || '],"event_time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S') || '","description":"' || replace(description, '"', chr(92) || '"') || '"}'"""
BY_SEVERITY = "'{' || array_to_string(list_transform(['critical', 'high', 'medium', 'low', 'clean'], lambda s: '\"' || s || '\": ' || len(list_filter(all_severities, lambda x: x = s))), ', ') || '}'"


def joined_document(head: list[str], foot: str) -> str:
    """Numbered lines: SQL expressions of the header, the rows with a comma before all but the first, the end."""
    return f"with {TE}, c as (select count(*) as n, list(severity) as all_severities from te) " + " union all ".join([f"select {i - len(head) + 1}::bigint as no, {h} as line from c" for i, h in enumerate(head)]) + f"""
union all select {FILE_ORDER}, case when {FILE_ORDER} > 1 then ',' else '' end || {JSON_LINE} from te union all select 4611686018427387904, ']' union all select 4611686018427387905, '}}'"""


def unescaped(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def plain(x: str) -> str:
    """A text of a page without its tags, references decoded, white space collapsed, at most 500 characters."""
    x = unescaped(x)
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"case when len({flat}) > 500 then regexp_replace(substr({flat}, 1, 500), ' [^ ]*$', '') || '...' else {flat} end"


def element(tag: str) -> str:
    return f"nullif({plain(f"regexp_replace(nullif(regexp_extract(coalesce(html, ''), '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), ''), '(?s)<[^>]*>', '', 'g')")}, '')"


def meta(attr: str) -> str:
    return plain(f"nullif(regexp_extract(coalesce(html, ''), '(?is)<meta\\b[^>]*{attr}[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1), '')")


MUTED = "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "nav", "footer", "header"))
SHOWN = ["cross_source", "source_quality", "threat_type_severity", "threat_actor", "mitre_techniques", "ai_confidence", "keywords", "entropy", "geo_risk", "domain_age"]
FALLBACK = "array_to_string(list_transform((list_sort(list_filter([" + ", ".join(f"{{'k': -{n}, 'i': {i}, 'f': '{n}', 'm': {dims.FACTOR_MAX.get(n, 25)}}}" for i, n in enumerate(SHOWN)) + "], lambda x: x.k < 0)))[1:6], lambda x: x.f || ':' || -x.k || ':' || x.m), ',')"

ORACLES: dict[str, str] = {
    "risk_score_flagship": f"with {FLAG} select * exclude (ioc_type, ioc_value, source_name, event_time, threat_types, actors, techniques, description), {TOP} as top_factors, len(actors) > 0 as has_actor, len(techniques) > 0 as has_mitre, coalesce(threat_types[1], 'Unknown') as primary_threat from flag",
    "risk_score_grouped": GROUPED,
    "risk_score_typed": TYPED,
    "risk_score_legacy": LEGACY,
    "confidence_calc": f"with {GROUP} select ioc_type, ioc_value, n_events, len(sources) as n_sources, ({q(dims.SEVERITIES)})[worst] as max_severity, round(least(avg_confidence + least(len(sources) * 10, 30) + case when fst.d is not null then 10 else 0 end, 100), 4) as confidence from grp",
    "first_last_seen": f"with {GROUP} select ioc_type, ioc_value, strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') as last_seen, len(sources) as n_sources from grp",
    "cross_source_boost": f"with {FLAG}, c as (select *, count(*) over (partition by ioc_type, ioc_value) as seen_in from flag) select event_id, seen_in, least(risk_score + case when seen_in > 1 then least(seen_in * 10, 40) else 0 end, 100) as boosted from c",
    "cross_source": f"with {TE} select event_id, {CROSS} as points from te",
    "source_quality": f"with {TE}, x as (select *, source_name as s from te) select event_id, {QUALITY.replace('lambda s', 'lambda s')} as points, case {TIER} when 15 then 'trusted' when 8 then 'news' else 'other' end as tier, {CLASS} as class from x",
    "threat_type_score": f"with {TE} select event_id, {TYPE} as points, coalesce(list_min(list_transform(threat_types, lambda t: coalesce({found(LEVEL, 't')}, 5))), 5) as level from te",
    "actor_score": f"with {TE}, p as (select event_id, {ACTOR} as points from te) select event_id, points, case when points >= 25 then 'confirmed' when points >= 15 then 'suspected' when points > 0 then 'possible' else 'none' end as attribution from p",
    "mitre_score": f"with {TE} select event_id, {MITRE} as points, 'none' as sophistication from te",
    "confidence_bonus": f"with {TE} select event_id, {BONUS} as points from te",
    "domain_age_score": f"with {TE} select event_id, {AGE} as points from te",
    "decay": f"with {TE} select event_id, {DECAY} as factor, trunc(100 * {DECAY})::int as points from te",
    "classify_lexicon": f"with {TE}, l as (select event_id, list_filter({LEXICON}, lambda x: -x.k >= 0.3::double - 1e-9::double) as m from te) select event_id, array_to_string(list_transform(m, lambda x: x.l), ',') as predicted_types, coalesce(round(-m[1].k, 3), 0) as predicted_confidence from l",
    "classify_activity": f"with x as (select event_id, ({q([*dims.ACTIVITIES, 'Strange Thing', 'Credential Theft', ''])})[event_id % 20 + 1] as a, event_id % 2 = 0 as feed from events) select event_id, case when feed then coalesce({found(dims.ACTIVITIES, 'replace(lower(a), chr(32), chr(95))')}, nullif(a, ''), 'Unknown') end as rule_types, case when feed then 1.0::double end as rule_confidence from x",
    "sector_best": f"with {FLAG} select event_id, sector, sector_confidence as confidence, sector_bonus as bonus from flag",
    "sector_first": f"with {TE} select event_id, {first_sector()} as sector from te",
    "sector_summary": SUMMARY,
    "sector_api": SUMMARY.replace("ac as (select sector, array_to_string(list_sort(list(distinct a))[1:5], ',') as actors from (select sector, unnest(actors) as a from s) group by sector)", """ac as (select sector, array_to_string(list(a order by seen)[1:5], ',') as actors from
  (select sector, a, min({'e': event_id, 'p': p}) as seen from (select sector, event_id, unnest(actors) as a, generate_subscripts(actors, 1) as p from s) group by all) group by sector)"""),
    "national_level": """with s as (select (['finance', 'transport', 'energy', 'retail', 'healthcare'])[r_regionkey + 1] as id, r_regionkey as o, 1 + r_regionkey * 3 % 5 as l from region),
a as (select sum(l * 10 * case when id in ('finance', 'government', 'energy', 'healthcare') then 2 else 1 end)::bigint as score, count(*) filter (l >= 3) as affected, count(*) as total, arg_max(id, {'l': l, 'o': -o}) as top_sector, bool_or(id in ('finance', 'government', 'energy', 'healthcare') and l >= 4) as v from s)
select score, affected, total, top_sector, case when v or score >= 200 then 'critical' when affected >= 4 or score >= 120 then 'high' when affected >= 2 or score >= 60 then 'medium' else 'low' end as level from a""",
    "entropy_service": "select p_partkey, " + entropy("regexp_replace(lower(split_part(p_name, '.', 1)), '[^a-z0-9]', '', 'g')", 3) + " as entropy from part",
    "entropy_full": "select p_partkey, " + entropy("lower(p_name)", 2) + " as entropy from part",
    "keyword_hits": f"select doc_id, array_to_string({hits(WORDS, 'lower(text)')}, ',') as hits, least(5 * len({hits(WORDS, 'lower(text)')}), 25) as points from documents",
    "keyword_join": f"select word, count(*) as n from documents join (select unnest({q(WORDS)}) as word) on contains(lower(text), word) group by word",
    "actor_extract": f"with {TE} select event_id, array_to_string(actors, ',') as actors, array_to_string(list_sort(list_filter({q(dims.SIMPLE_ACTORS)}, lambda a: contains(low, lower(a)))), ',') as simple from te",
    "mitre_extract": f"with {TE} select event_id, array_to_string(techniques, ',') as techniques from te",
    "ioc_type_detect": f"with {TE} select event_id, ioc_type as detected from te",
    "severity_norm": f"with {TE} select event_id, severity, case lower(trim(severity_raw)) when 'high' then 'high' when 'medium' then 'medium' when 'low' then 'low' else 'clean' end as analyzed from te",
    "confidence_norm": f"with {TE} select event_id, confidence from te",
    "date_cascade": "select event_id, case event_id % 4 when 2 then 'soon' when 3 then '2024-01-31T00:00:00' else strftime(ts, '%Y-%m-%dT00:00:00') end as iso, case when event_id % 4 < 2 then date_diff('day', ts::date, date '2024-01-31') end as age from events",
    "bands": f"with {TE} select event_id, {BAND.format('confidence')} as service, {DBAND.format('confidence')} as dashboard, case when confidence >= 80 then 'red' when confidence >= 60 then 'orange' when confidence >= 40 then 'yellow' when confidence >= 20 then 'blue' else 'green' end as color, confidence || '/100' as text from te",
    "title_from_url": f"with {TE} select event_id, {TITLE} as title, {NEWS} as source, split_part(reference, '/', 3) as netloc, split_part(regexp_replace(ioc_value, '^https?://', ''), '/', 1) as host from te",
    "clean_text": f"with c as (select doc_id, {CLEAN} as t from documents) select doc_id, md5(case when len(t) > 500 then regexp_replace(substr(t, 1, 500), ' [^ ]*$', '') || '...' else t end) as clean from c",
    "search_substring": f"with {TE} select event_id, ioc_type, severity from te where severity in ('high', 'critical') and (contains(lower(ioc_value), 'bank') or contains(low, 'bank') or len(list_filter(tags, lambda t: contains(lower(t), 'bank'))) > 0)",
    "search_tokens": f"with {TE} select event_id, ioc_type from te where ioc_type in ('ip', 'url') and regexp_matches(low, '(^|[^a-z0-9])(ransomware|portal)($|[^a-z0-9])')",
    "search_filters": f"with {TE} select event_id, source_name from te where source_name in ('VirusTotal', 'Sandbox') and list_contains(threat_types, 'APT') and event_time between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 00:00:00'",
    "search_paged": f"with {FLAG} select event_id, risk_score from flag order by risk_score desc, event_time desc, event_id limit 50 offset 20",
    "facets": f"with {TE} select distinct 'source' as facet, source_name as value from te union select 'threat_type', unnest(threat_types) from te union select 'actor', unnest(actors) from te",
    "related_events": f"with {TE} select event_id, ioc_type, ioc_value from te where lower(ioc_value) = 'cve-2024-0042'",
    "focused_ioc": f"with {FLAG}, x as (select f.*, te.severity as sv from flag f join te using (event_id) where f.ioc_type = 'cve' and f.ioc_value = 'CVE-2024-0042'), y as (select *, row_number() over (order by event_time, event_id) as r, count(*) over () as n_events, (select array_to_string(list_sort(list(distinct source_name)), ',') from x) as srcs from x) select ioc_type, ioc_value, event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, sv as severity, risk_score as score, false as pending, srcs as sources, n_events from y where r = 1",
    "urls_to_classify": f"with {TE} select reference, count(*) as n, count(distinct (ioc_value, source_name)) as n_iocs from te where reference not in (select reference from te where user_id % 2 = 1 and event_id % 3 = 0) group by reference",
    "url_classification": f"with {TE} select event_id, case when len(threat_types) = 0 then 'Phishing' else array_to_string(threat_types, ',') end as threat_types, case when len(actors) = 0 then 'Turla' else array_to_string(actors, ',') end as actors, case when len(threat_types) = 0 then 0.7::double else ai_confidence end as ai_confidence from te",
    "reuse_split": f"with {TE}, u as (select distinct ioc_type, ioc_value from te where user_id % 3 = 0 and (user_id % 2 = 0 or (user_id % 9 = 0 and len(description) >= 20))) select event_id, case when u.ioc_value is null then 'new' else 'reused' end as branch from te left join u using (ioc_type, ioc_value)",
    "dashboard_stats": f"with {TE} select 'type' as dimension, ioc_type as key, count(*) as n from te group by ioc_type union all select 'severity', severity, count(*) from te group by severity union all select 'source', source_name, count(*) from te group by source_name",
    "stats_by_threat_type": f"with {TE} select threat_type, count(*) as n from (select unnest(threat_types) as threat_type from te) group by threat_type",
    "top_items": f"with {TE} " + " union all ".join(f"({top_item(f, s)})" for f, s in (("ioc_type", "select ioc_type as key from te"), ("source_name", "select source_name as key from te"), ("threat_types", "select unnest(threat_types) as key from te"), ("severity", "select severity as key from te"))),
    "recent_alerts": f"with {TE} select event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, ioc_type, severity from (select * from te order by event_time desc, event_id limit 10)",
    "avg_risk": f"with {FLAG} select ioc_type, round(avg(risk_score), 6) as avg_risk, count(*) as n from flag group by rollup (ioc_type)",
    "severity_distribution": f"with {TE} select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low, 0::bigint as clean from te",
    "home_severity": f"with {TE} select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from te",
    "bucket_map": f"with {TE}, c as (select severity, count(*) as n from te group by severity) select '{{' || string_agg('\"' || severity || '\":' || n, ',' order by severity) || '}}' as buckets from c",
    "events_by_day": "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where ts >= timestamp '2024-01-17 00:00:00' group by 1",
    "percent_of_total": f"with {TE}, c as (select severity as key, count(*) as n from te group by severity), w as (select *, sum(n) over () as total, max(n) over () as top, sum(n) over (order by n desc, key rows unbounded preceding) as upto from c) select key, n, round(n * 100.0::double / total, 4) as percent, round(n * 100.0::double / top, 4) as percent_of_max, round(upto * 100.0::double / total - n * 100.0::double / total, 4) as start, round(upto * 100.0::double / total, 4) as \"end\" from w",
    "report_summary": f"with {TE} select count(*) as total, count(*) filter (severity in ('critical', 'high')) as critical_high, count(distinct source_name) as sources, count(distinct ioc_type) as types from te",
    "alerts": f"with {ALERTS} select * from alerts",
    "alert_kpis": f"with {ALERTS}, k as (select *, case when event_id % 3 <> 0 then 'open' when event_id % 2 = 0 then 'resolved' else 'acknowledged' end as st from alerts) select count(*) as total, count(*) filter (st = 'open') as open, count(*) filter (st = 'acknowledged') as acknowledged, count(*) filter (st = 'resolved') as resolved, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high from k",
    "cve_search": f"with {TE} select count(*) as total, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from te where ioc_type = 'cve' and contains(ioc_value, '2024-00')",
    "tickets": f"""with {FLAG}, n as (select *, row_number() over (partition by event_time::date order by event_time, event_id) as no, case when risk_score = 0 then 50 else risk_score end as risk from flag)
select 'TKT-' || strftime(event_time, '%Y%m%d') || '-' || case when no < 10000 then lpad(no::varchar, 4, '0') else no::varchar end as ticket_id, event_id,
  '[' || upper(severity) || '] ' || case when len(threat_types) > 0 then array_to_string(threat_types[1:2], ', ') else 'Unknown Threat' end || ' - ' || ioc_type || ': ' || substr(ioc_value, 1, 50) as title,
  case when severity = 'clean' then 'medium' else severity end as priority, case when len(threat_types) > 0 then 'threat' else 'incident' end as category, risk,
  md5('## Threat Intelligence Alert' || chr(10) || chr(10) || '**IOC Value:** `' || ioc_value || '`' || chr(10) || '**IOC Type:** ' || ioc_type || chr(10) || '**Risk Score:** ' || risk || '/100' || chr(10) || '**Severity:** ' || upper(severity) || chr(10) || chr(10)
  || '**Threat Types:** ' || case when len(threat_types) > 0 then array_to_string(threat_types, ', ') else 'Not classified' end || chr(10) || '**Threat Actors:** ' || case when len(actors) > 0 then array_to_string(actors, ', ') else 'Unknown' end || chr(10) || chr(10) || '## Description' || chr(10) || description) as body from n""",
    "daily_by_type": f"with {DAILY} select {DAY}, threat_type, n from daily",
    "trend_regression": f"with {REGRESSION} select * from trends",
    "trend_predictions": f"""with {REGRESSION} select threat_type, slope, case direction when 'increasing' then threat_type || ' trending up +' || change_percent || '% next week' when 'decreasing' then threat_type || ' trending down ' || change_percent || '% next week' else threat_type || ' stable trend' end as prediction_text,
  case when direction = 'increasing' and change_percent > 20 then 'warning' when direction = 'increasing' then 'info' when direction = 'decreasing' then 'success' else 'neutral' end as alert_level from trends order by abs(slope) desc, threat_type limit 5""",
    "trend_summary": f"with {REGRESSION} select count(*) as total, count(*) filter (direction = 'increasing') as increasing, count(*) filter (direction = 'decreasing') as decreasing, count(*) filter (direction = 'stable') as stable from trends",
    "trend_forecast": f"""with {REGRESSION}, best as (select threat_type, sum(n) as t from daily group by threat_type order by t desc, threat_type limit 5), s as (select series.* from series join best using (threat_type)), l as (select threat_type, max(day) as last, arg_max(n, day) as v from s group by threat_type)
select threat_type, {DAY}, 'history' as segment, n::double as value from s union all select threat_type, strftime(last, '%Y-%m-%d'), 'transition', v::double from l
union all select threat_type, strftime(last + i::int, '%Y-%m-%d'), 'forecast', greatest(0, round_even(current_avg + slope * i, 0)) from l join trends using (threat_type), range(1, 8) r(i)""",
    "geo_threats": f"with {GEO} select * from geo",
    "geo_totals": f"with {GEO} select sum(n)::bigint as events, count(*) as countries from geo",
    "news_rollup": f"with {ARTICLES} select * from articles",
    "news_by_source": f"with {ARTICLES} select source, count(*) as n from articles group by source",
    "graph_nodes": f"with {NODES} select * from nodes",
    "graph_edges": f"with {NODES} select * from links",
    "graph_stats": f"with {STATS} select type as metric, count(*) as n from nodes group by type union all select 'links', count(*) from links",
    "export_suricata": f"""with {TE}, n as (select *, 8999999 + row_number() over (order by event_time, event_id) as sid from te where ioc_type in ('ip', 'domain', 'url'))
select sid, event_id, case ioc_type when 'ip' then 'alert ip ' || ioc_value || ' any -> any any (msg:"CTI IP: ' || source_name || '"; sid:' || sid || '; rev:1;)' when 'domain' then 'alert dns any any -> any any (msg:"CTI DOMAIN: ' || source_name || '"; dns.query; content:"' || ioc_value || '"; nocase; sid:' || sid || '; rev:1;)'
  else 'alert http any any -> any any (msg:"CTI URL: ' || source_name || '"; http.host; content:"' || split_part(ioc_value, '/', 3) || '"; nocase; sid:' || sid || '; rev:1;)' end as rule from n""",
    "export_snort": f"""with {TE}, n as (select *, 8999999 + row_number() over (order by event_time, event_id) as sid from te where ioc_type in ('ip', 'domain'))
select sid, event_id, case ioc_type when 'ip' then 'alert ip ' || ioc_value || ' any <> any any (msg:"CTI IP: ' || source_name || '"; sid:' || sid || '; rev:1;)' else 'alert udp any any -> any 53 (msg:"CTI DOMAIN: ' || source_name || '"; content:"|' || lpad(lower(to_hex(len(ioc_value))), 2, '0') || '|' || ioc_value || '"; nocase; sid:' || sid || '; rev:1;)' end as rule from n""",
    "export_csv": f"""with {TE} select event_id, ioc_type || ',"' || ioc_value || '",' || severity || ',' || confidence || ',' || source_name || ',' || array_to_string(threat_types, ';') || ',' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || ',"' || replace(description, '"', '""') || '"' as line from te""",
    "export_json": f"""with {TE} select event_id, '{{"type":"' || ioc_type || '","value":"' || ioc_value || '","severity":"' || severity || '","confidence":' || confidence || ',"source":"' || source_name || '","threat_type":[' || array_to_string(list_transform(threat_types, lambda t: '"' || t || '"'), ',') || '],"event_time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S') || '","description":"' || replace(description, '"', '\\"') || '"}}' as document from te""",
    "export_blocklist": f"with {TE} select distinct ioc_type, ioc_value from te where ioc_type in ('ip', 'domain') and severity in ('high', 'critical')",
    "export_text": f"with {TE} select ioc_type, ioc_value, event_id, count(*) over (partition by ioc_type) as n from te",
    "json_shapes": f"with {TE} select event_id, ioc_type, ioc_value, source_name, array_to_string(threat_types, ',') as threat_types, severity, confidence from te",
    "incremental_pipeline": f"with {FLAG}, k as (select *, row_number() over (partition by ioc_type, ioc_value order by event_id desc) as r from flag) select ioc_type, ioc_value, event_id, risk_score, severity as ai_severity from k where r = 1",
    "stream_daily_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all",
    "keyword_points": f"with {TE} select event_id, array_to_string({hits(dims.SERVICE_KEYWORDS, 'low')}, ',') as hits, least(5 * len({hits(dims.SERVICE_KEYWORDS, 'low')}), 25) as points from te",
    "url_indicators": f"with {TE} select reference, ioc_value, source_name, count(*) as n from te where not contains(reference, 'darkreading') and reference not in (select reference from te where user_id % 2 = 1) group by all",
    "search_tags": f"with {TE} select event_id, ioc_type from te where contains(lower(ioc_value), 'tmpl-1') or contains(low, 'tmpl-1') or len(list_filter(tags, lambda t: contains(t, 'tmpl-1'))) > 0",
    "search_relevance": f"""with {TE}, r as (select event_id, case when ioc_value = 'APT' then 3 else 0 end + case when regexp_matches(low, '(^|[^a-z0-9])apt($|[^a-z0-9])') then 1 else 0 end
  + list_contains(tags, 'APT')::int + list_contains(threat_types, 'APT')::int + list_contains(actors, 'APT')::int as relevance from te) select event_id, relevance::double as relevance from r where relevance > 0""",
    "search_ranked": f"""with {TE}, base as (select event_id as id, low as text, ioc_value, tags, threat_types, actors from te), {BM25("['ransomware', 'portal', 'bank']", "a")}, {BM25("['apt']", "b")},
kw as (select id, unnest([{{'f': 'ioc_value', 'boost': 3.0, 'v': [ioc_value]}}, {{'f': 'tags', 'boost': 1.0, 'v': tags}}, {{'f': 'threat_types', 'boost': 1.0, 'v': threat_types}}, {{'f': 'actors', 'boost': 1.0, 'v': actors}}]) as x from base),
kn as (select x.f as f, count(*) filter (len(x.v) > 0) as n from kw group by all),
kq as (select id, x.f as f, x.boost::double as boost, q, len(list_filter(x.v, lambda e: e = q)) as tf from (select *, unnest(['ransomware portal bank', 'APT']) as q from kw)),
kd as (select f, q, count(*) as df from kq where tf > 0 group by all),
ks as (select q, id, round(boost * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf / (tf + 1.2::double) * 1e9)::bigint / 1e9::double as s from kq join kd using (f, q) join kn using (f) where tf > 0),
every as (select 'ransomware portal bank' as q, id, s from s_a union all select 'APT', id, s from s_b union all select * from ks),
best as (select q, id, round(max(s), 6) as score from every group by all)
select q as query, id as event_id, score from best qualify row_number() over (partition by q order by score desc, id) <= 50""",
    "part_names_in_documents": """with w as (select distinct w from (select unnest(string_split_regex(lower(p_name), '[^a-z]+')) as w from part union all select unnest(string_split_regex(lower(n_name), '[^a-z]+')) from nation) where w <> '')
select doc_id, w as word from (select doc_id, lower(text) as low from documents) join w on contains(low, w) group by all""",
    "actor_join": f"with {TE} select event_id, array_to_string(actors, ',') as actors from te",
    "classify_trained": f"with {TE}, base as (select event_id as id, description as text, threat_types[1] as label, event_id % 4 <> 2 as known from te), {BAYES} select id as event_id, label, confidence from found",
    "documents_classified": f"with base as (select doc_id as id, text, lang as label, lang is not null and doc_id % 4 <> 2 as known from documents), {BAYES} select id as doc_id, label, confidence from found",
    "documents_ranked": f"""with base as (select doc_id as id, lower(coalesce(text, '')) as text from documents), {BM25("['the', 'worthless', 'entre', 'la', 'thention', 'und']", "a")}
select id as doc_id, round(s, 6) as score from s_a order by round(s, 6) desc, id limit 100""",
    "documents_containing": "select doc_id, length(text)::bigint as n_chars from documents where contains(lower(text), 'gnu general')",
    "bucketed_upsert": f"with {TE}, r as (select *, row_number() over (partition by ioc_type, ioc_value order by event_time desc, event_id desc) as k from te) select ioc_type, ioc_value, event_id, source_name from r where k = 1",
    "bucketed_unknown": f"with {TE}, known as (select distinct ioc_type, ioc_value from te where event_id % 4 = 0) select event_id, ioc_type, ioc_value from te anti join known using (ioc_type, ioc_value)",
    "rollup_dashboard": f"with {TE} select 'type' as dimension, ioc_type as key, count(*) as n from te group by ioc_type union all select 'severity', severity, count(*) from te group by severity union all select 'source', source_name, count(*) from te group by source_name",
    "rollup_risk": f"with {FLAG} select ioc_type, round(avg(risk_score), 6) as avg_risk, count(*) as n from flag group by rollup (ioc_type)",
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events where date_trunc('day', ts) + interval 2 day <= (select max(ts) from events) group by all",
    "stream_new_indicators": f"with {TE} select distinct ioc_type, ioc_value from te",
    "stream_alerts": f"with {ALERTS} select alert_id, case when event_id % 2 = 0 then 'resolved' else 'acknowledged' end as status, strftime(event_time::timestamp + interval 1 hour, '%Y-%m-%d %H:%M:%S') as acknowledged_at from alerts where event_id % 3 = 0",
    "search_scored": f"with {TE} select event_id from te where event_id % 3 = 0 or severity = 'critical'",
    "search_limited": f"with {TE}, f as (select event_id, count(*) over () as total from te where ioc_type = 'ip' and source_name = 'VirusTotal') select * from f order by event_id limit 25",
    "search_offset": f"with {TE} select event_id, ioc_type from te order by event_id limit 40 offset 15",
    "warehouse_events": f"""with {TE} select ioc_type, ioc_value, 'unknown' as source_type, case when event_id % 2 = 0 then source_name else 'unknown' end as source_name, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time,
  strftime(event_time + interval 1 day, '%Y-%m-%d %H:%M:%S') as collect_time, array_to_string(threat_types, ',') as threat_types, case when event_id % 5 = 0 then severity else 'high' end as severity, 0::double as confidence, '' as description, 'active' as status from te""",
    "score_write_back": f"with g as ({GROUPED}), {TE} select te.event_id, g.risk_score, g.severity as severity_ai, g.type_specific from te join g using (ioc_type, ioc_value)",
    "breakdown_categories": f"""with {FLAG} select event_id, 'Cross-Source Validation:' || cross_source || ':40,IOC Characteristics:' || case when event_id % 2 = 0 then domain_age else 0 end || ':25,Entropy (DGA Detection):' || entropy || ':20,Keyword Context:' || keywords || ':15'
  || case when event_id % 2 = 1 and source_quality > 0 then ',Source Severity:' || source_quality || ':15' else '' end as categories from flag""",
    "breakdown_summary": f"with {FLAG} select event_id, traditional_score::double as traditional_score, ai_score::double as ai_score, len(actors) > 0 as has_threat_actor, len(techniques) > 0 as has_mitre, threat_types[1] as primary_threat from flag where event_id % 2 = 1",
    "breakdown_factors": f"with {FLAG} select event_id, {FALLBACK} as factors from flag where event_id % 2 = 1",
    "breakdown_enhanced": f"""with {FLAG}, x as (select f.*, te.severity as raw from flag f join te using (event_id)) select event_id, case when event_id % 5 = 0 then 0 else risk_score end as total_score, case when event_id % 3 = 0 then raw else severity end as severity,
  {found(dims.SEVERITY_TH, 'severity')} as severity_th, '{{}}' as breakdown, least(5, len(list_filter([cross_source, source_quality, keywords, entropy, geo_risk, domain_age, threat_type_severity, threat_actor, mitre_techniques, ai_confidence], lambda p: p > 0)))::int as n_factors, false as has_mitre from x""",
    "keyword_severity_terms": f"with {TE} (select row_number() over (order by n desc, key) as rank, key, n, 'threat_types' as field from (select key, count(*) as n from (select unnest(threat_types) as key from te) group by key order by n desc, key limit 20)) union all (select row_number() over (order by n desc, key), key, n, 'ioc_type' from (select ioc_type as key, count(*) as n from te group by key order by n desc, key limit 10))",
    "sectors_ranked": f"select sector, n, threat_level from ({SUMMARY}) where sector <> 'general'",
    "sector_tagged": f"""with {TE}, t2 as (select * replace (lower({TITLE} || ' ' || description || ' ' || array_to_string(case when user_id % 5 = 0 then ['bank', 'hospital'] else tags end, ' ')) as low) from te), s as (select event_id, {sector_structs()} as sec from t2)
select event_id, case when sec.s > 0 then sec.n else 'general' end as sector, case when sec.s > 0 then round(least(sec.s, 1.0::double), 2) else 0::double end as confidence, case when sec.s > 0 then sec.b else 0 end as bonus from s""",
    "daily_by_collect": f"with {TE} select strftime(case when event_id % 13 = 0 then event_time + interval 1 day else event_time end, '%Y-%m-%d') as day, t as threat_type, count(*) as n from (select event_id, event_time, unnest(case when len(threat_types) > 0 then threat_types else ['Unknown'] end) as t from te) group by all",
    "trend_steepest": f"with {REGRESSION} select threat_type, change_percent from trends where direction = 'increasing' order by change_percent desc, threat_type limit 3",
    "geo_paths": f"""with {TE}, {COUNTRIES}, p as (select case when country_code in (select code from cn) and country_code <> 'TH' then country_code else 'US' end as code, severity from te),
g as (select code, count(*) as n, arg_max(severity, list_position({q(dims.SEVERITIES)}, severity)) as primary_severity from p group by code), w as (select *, round(1.5::double + n::double / max(n) over () * 4, 6) as stroke from g) select * from w order by n desc, code limit 5""",
    "country_ingest": f"with {TE} select event_id, coalesce(nullif(case when user_id % 4 = 0 then country_code end, ''), case when user_id % 3 = 0 then 'DE' end, nullif(country_code, '')) as country from te",
    "news_search": f"with {ARTICLES} select id, title, date, ioc_count from articles where source = 'DarkReading' and contains(lower(title), 'breach')",
    "alert_search": f"with {ALERTS} select alert_id, event_id from alerts where severity = 'high' and event_id % 7 = 1",
    "focused_graph": f"with {GRAPH.replace('{where}', "where ioc_type = 'cve' and ioc_value = 'CVE-2024-0042'")} select id, label, type from nodes",
    "entity_graph": f"with {GRAPH.replace('{where}', 'where user_id % 4 = 0 or user_id % 6 = 0')} select type as metric, count(*) as n from nodes group by type union all select 'links', count(*) from links",
    "ingest_gates": f"""with {TE}, d as (select *, substr(description, 1, (event_id % 40)::int) as t, {TITLE} as title from te)
select event_id, {any_in([s.lower() for s in dims.SCRAPABLE_SOURCES], 'lower(source_name)')} and len(trim(t)) < 20 as scrape, len(t) > 20 or len(title) > 20 as analyse, title || case when t = '' then '' else ' - ' || t end as description from d""",
    "domain_ages": f"with {TE} select event_id, case when event_id % 4 < 2 then floor((epoch(timestamp '{dims.AS_OF}') - floor(epoch(event_time))) / 86400) when event_id % 3 = 0 then date_diff('day', event_time::date, date '{dims.AS_OF[:10]}') end as age from te",
    "page_summaries": f"""with p as (select page_id, url, {element('title')} as title, coalesce({meta('name=["\'\']description')}, {meta('property=["\'\']og:description')}, nullif(concat_ws(' - ', {element('h1')}, {element('p')}), '')) as description from pages)
select *, len(coalesce(description, '')) >= 20 as success from p""",
    "page_text": f"select page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is){MUTED}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 1000) as text from pages",
    "csv_document": f"with {TE} select 0::bigint as no, 'IOC Type,IOC Value,Severity,Confidence,Source,Threat Type,Event Time,Description' as line union all select {FILE_ORDER}, {CSV_LINE} from te",
    "json_document": joined_document(["'{'", "'\"meta\": {\"source\": \"feed\", \"total\": ' || n || '},'", "'\"iocs\": ['"], "]"),
    "stats_document": joined_document(["'{'", f"'\"stats\": {{\"totalEvents\": ' || n || ', \"bySeverity\": ' || {BY_SEVERITY} || '}},'", "'\"events\": ['"], "]"),
    "text_document": f"""with {TE} select '' as part, 0::bigint as no, '# Total IOCs: ' || count(*) as line from te union all select ioc_type, 0, '## ' || upper(ioc_type) || ' (' || count(*) || ')' from te group by ioc_type
union all select ioc_type, row_number() over (partition by ioc_type order by event_id), ioc_value from te""",
    "blocklist_document": f"""with {TE}, b as (select ioc_type, ioc_value from te where ioc_type in ('ip', 'domain') and severity in ('high', 'critical'))
select ioc_type || '-0' as part, case ioc_type when 'ip' then '# IP Addresses (' else '# Domains (' end || count(*) || ')' as line from b group by ioc_type union all select distinct ioc_type || '-1', ioc_value from b""",
    "url_master": f"with {TE} select reference as url, case when max(event_id) % 2 = 0 then 'class 1' else 'class 0' end as class from te group by reference",
}
TERM_LIST = [*dims.TERMS, "Zero Day"]
ORACLES["page_articles"] = f"""with p as (select page_id, substr(coalesce({element('title')}, ''), 1, 200) as title, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) as a from pages),
t as (select page_id, title, trim(regexp_replace(regexp_replace(regexp_replace(a, '(?is){MUTED}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as t from p) select page_id, title, substr({unescaped('t')}, 1, 1000) as content from t"""
ORACLES["analysis_verdicts"] = f"""with {TE}, x as (select *, event_id % 7 = 0 as none, confidence_raw * 2 - 50 as c from te)
select event_id, case when not none then case lower(trim(severity_raw)) when 'high' then 'high' when 'medium' then 'medium' when 'low' then 'low' else 'clean' end end as severity,
  case when not none then case when c = 0 then 50 else greatest(0, least(100, c)) end end::double as confidence, case when not none then len(actors) end as n_actors,
  case when not none then case when event_id % 2 = 0 then 'phishing' else 'other' end end as category, case when not none then greatest(0, least(100, confidence_raw + 40)) end::double as score from x"""
ORACLES["shown_labels"] = f"""with {TE}, x as (select *, ({q(TERM_LIST)})[event_id % {len(TERM_LIST)} + 1] as term, substr(description, 1, (event_id % 12)::int) as t from te)
select event_id, array_to_string(list_transform(string_split(term, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as label, coalesce({found(dims.TERMS, 'lower(term)')}, upper(term)) as thai, case when len(trim(t)) >= 5 then t end as prepared from x"""
ORACLES["suricata_document"] = f"with r as ({ORACLES['export_suricata']}) select -2::bigint as no, '# Suricata Rules Export' as line union all select -1, '# Total Rules: ' || count(*) from r union all select 0, '' union all select sid - 8999999, rule from r"
ORACLES["ticket_log"] = f"with t as ({ORACLES['tickets']}) select '{{\"ticket_id\":\"' || ticket_id || '\",\"event_id\":' || event_id || ',\"title\":\"t\",\"priority\":\"' || priority || '\",\"category\":\"' || category || '\",\"risk\":' || risk || '}}' as value from t"
