"""Text and value functions as column expressions; all stay inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def listed(words) -> Column:
    """A constant array of strings in one expression, however many they are; Spark folds it when it plans."""
    return F.split(F.lit("\n".join(words)), "\n") if words else F.array().cast("array<string>")


def literals(values) -> Column:
    if len(values) > 3 and all(isinstance(v, str) and "\n" not in v for v in values):
        return listed(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(mapping: dict, key: Column) -> Column:
    """The value of `key` in a small constant mapping; null where it has none. Of strings to strings or numbers of one type it is one expression."""
    kinds = {type(v) for v in mapping.values()}
    if len(mapping) > 3 and len(kinds) == 1 and kinds <= {str, int, float} and all(isinstance(k, str) and not {"\n", "\t"} & {*k, *str(v)} for k, v in mapping.items()):
        found = F.try_element_at(F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in mapping.items())), F.lit("\n"), F.lit("\t")), key)
        kind = kinds.pop()
        return found if kind is str else found.cast("int" if kind is int else "double")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def let(value: Column, body) -> Column:
    """`body` of `value`, computed once: what a lambda takes in from outside is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bands(value: Column, steps: list[tuple], otherwise) -> Column:
    """The label of the first step whose floor `value` reaches."""
    out = reduce(lambda c, s: c.when(value >= s[0], s[1]), steps[1:], F.when(value >= steps[0][0], steps[0][1]))
    return out.otherwise(otherwise)


def contains_any(text: Column, words) -> Column:
    if len(words) > 3:
        return let(text, lambda t: F.exists(listed(words), lambda w: F.contains(t, w)))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def named_hits(cases: list[tuple]) -> Column:
    """The names whose condition holds, in order. No lambda, so it stays in generated code; names hold no line feed."""
    joined = F.concat_ws("\n", *[F.when(c, F.lit(n)) for n, c in cases])
    return F.when(joined == "", literals([])).otherwise(F.split(joined, "\n"))


def count_hits(text: Column, words) -> Column:
    """How many of the words occur in a (lower-case) text."""
    if len(words) > 3:
        return let(text, lambda t: F.size(F.filter(listed(words), lambda w: F.contains(t, w))))
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of `text`; 0 for null or empty text."""

    def of(text: Column) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        # one replacement for each distinct character, not a test of every pair
        shares = F.transform(F.array_distinct(chars), lambda u: (F.length(text) - F.length(F.replace(text, u, F.lit("")))) / F.length(text))
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.coalesce(let(text, of), F.lit(0.0))


def entropy_service(value: Column) -> Column:
    """Of the lower-cased letters and digits before the first dot, to 3 places."""
    label = F.regexp_replace(F.lower(F.substring_index(value, ".", 1)), r"[^\p{L}\p{N}]", "")
    return F.round(entropy(label), 3)


def entropy_full(value: Column) -> Column:
    """Of all characters of the lower-cased value, to 2 places."""
    return F.round(entropy(F.lower(value)), 2)


def keyword_hits(text: Column, keywords=dims.SERVICE_KEYWORDS) -> Column:
    """The keywords that occur in the text, in dictionary order; a null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda t: F.filter(listed(keywords), lambda k: F.contains(t, k)))


def mitre_techniques(text: Column) -> Column:
    """Technique ids in upper case, in order of appearance, duplicates kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bT\d{4}(?:\.\d{3})?\b"), F.lit(0))
    return F.transform(found, F.upper)


def threat_actors(text: Column, actors=dims.TEXT_ACTORS) -> Column:
    """Actors whose name or an alias occurs in the text, any case, by canonical name in dictionary order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # aliases and, at the same places, their actors: a test cuts no string
    named = [(x.lower(), n) for n, al in actors.items() for x in (n, *al)]
    aliases, names = listed([x for x, _ in named]), listed([n for _, n in named])
    hits = let(low, lambda t: F.filter(F.transform(aliases, lambda x, i: F.when(F.contains(t, x), i)), lambda i: i.isNotNull()))
    return F.array_distinct(F.transform(hits, lambda i: F.get(names, i)))


def threat_actors_simple(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda t: F.filter(listed(sorted(dims.SIMPLE_ACTORS)), lambda n: F.contains(t, F.lower(n))))


def severity(raw: Column) -> Column:
    """One of critical, high, medium, low, clean; what is empty or unknown is low."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(s.isin("critical", "very high"), "critical").when(s.isin("high", "medium"), s).when(s.isin("clean", "info"), "clean").otherwise("low")


def severity_analyzed(raw: Column) -> Column:
    """As `severity`, for analysed results: what is unknown is clean."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(s.isin("critical", "high", "medium", "low"), s).otherwise("clean")


def confidence(raw: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(raw, F.lit(0))))


def ioc_type(value: Column) -> Column:
    """By shape: cve, sha256, sha1, md5, ip, url, else domain."""
    return (
        F.when(value.rlike(r"(?i)^CVE-\d{4}-\d+$"), "cve").when(value.rlike(r"(?i)^[a-f0-9]{64}$"), "sha256").when(value.rlike(r"(?i)^[a-f0-9]{40}$"), "sha1")
        .when(value.rlike(r"(?i)^[a-f0-9]{32}$"), "md5").when(value.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip").when(value.rlike(r"^https?://"), "url")
        .otherwise("domain")
    )


def timestamp(raw: Column) -> Column:
    """ISO forms with or without offset, then plain dates and day-first dates; null where none fits."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy"]
    return F.coalesce(F.try_to_timestamp(raw), *[F.try_to_timestamp(raw, F.lit(f)) for f in forms])


def date_or_raw(raw: Column, as_of: str = dims.AS_OF) -> Column:
    """The instant in ISO form; what can't be read passes through, and null or empty is `as_of`."""
    iso = F.date_format(timestamp(raw), "yyyy-MM-dd'T'HH:mm:ss")
    now = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.coalesce(raw, F.lit("")) == "", now).otherwise(F.coalesce(iso, raw))


def age_days(when: Column, as_of: str = dims.AS_OF) -> Column:
    """Whole days from a timestamp to `as_of`."""
    return F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(when)) / 86400).cast("int")


def domain_age_days(created: Column, registered: Column, as_of: str = dims.AS_OF) -> Column:
    return age_days(F.coalesce(timestamp(created), timestamp(registered)), as_of)


def url_host(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, r"^https?://", ""), "/", 1)


def netloc(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def title_from_url(url: Column) -> Column:
    """The last path segment without extension (its parent's name for an index page), in title case."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    slug = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"(?i)\.(html|htm|php|aspx?)$", "")
    slug = F.when(F.lower(slug) == "index", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("Article"))).otherwise(slug)
    title = F.initcap(F.regexp_replace(slug, "[-_]", " "))
    return F.when(title == "", "Untitled Article").otherwise(F.coalesce(title, F.lit("Untitled Article")))


def news_source(url: Column, name: Column) -> Column:
    cases = [F.when(F.contains(url, F.lit(site)), F.lit(n)) for site, n in dims.NEWS_SITES.items()]
    return F.coalesce(*cases, name)


def is_news_url(url: Column) -> Column:
    return F.coalesce(contains_any(url, dims.NEWS_SITES), F.lit(False))


def clean_text(text: Column, limit: int = 500) -> Column:
    """White space collapsed and trimmed; beyond `limit` characters cut at the last space, with `...`."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, limit)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(flat) > limit, F.concat(cut, F.lit("..."))).otherwise(flat)


def strip_html(html: Column, limit: int = 1000) -> Column:
    """Text without script, style, nav, footer and header elements and tags; its first `limit` characters."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)\b.*?</\1\s*>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " ")), 1, limit)


def enriched_description(title: Column, description: Column) -> Column:
    return F.concat_ws(" - ", F.nullif(title, F.lit("")), F.nullif(description, F.lit("")))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def source_tier(name: Column) -> Column:
    of = lambda names: name.rlike("(?i)" + "|".join(names))  # noqa: E731  the names hold no pattern characters
    return F.when(of(dims.TRUSTED_SOURCES), "trusted").when(of(dims.NEWS_SOURCES), "news").otherwise("other")


def source_class(name: Column) -> Column:
    """threat_intel, sandbox, security_tool or news, by part of the name, in this order; else evidence or other."""
    low = F.lower(name)
    out = reduce(lambda c, kv: c.when(contains_any(low, [x.lower() for x in kv[1]]), kv[0]), list(dims.SOURCE_CLASSES.items()), F.when(F.lit(False), ""))
    return out.when(contains_any(low, dims.EVIDENCE_WORDS), "evidence").otherwise("other")


def service_band(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").when(score > 0, "low").otherwise("clean")


def dashboard_band(score: Column) -> Column:
    return bands(score, dims.DASHBOARD_BANDS, "clean")


def score_color(score: Column) -> Column:
    return bands(score, [(80, "red"), (60, "orange"), (40, "yellow"), (20, "blue")], "green")


def score_text(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").otherwise(F.concat(score.cast("string"), F.lit("/100")))


def prettified(label: Column) -> Column:
    return F.initcap(F.regexp_replace(label, "_", " "))


def activity_key(activity: Column) -> Column:
    return F.regexp_replace(F.lower(activity), " ", "_")


def node_id(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "_")


def marker_radius(n: Column) -> Column:
    return 3 + F.log2(n + 1) * 1.2


def arc_width(n: Column, most: Column) -> Column:
    return 1.5 + n / most * 4


def unescaped(text: Column) -> Column:
    """The named character references of markup and the space, and the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def prepared_for_translation(text: Column) -> Column:
    """Null under 5 characters, else the first 4000."""
    return F.when(F.length(F.trim(text)) >= 5, F.substring(text, 1, 4000))
