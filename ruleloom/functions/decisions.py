"""Decision tables and classifications as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def document_status(action: Column, kind: Column) -> Column:
    """The document's status from its action and type; notices first, and final where neither tells."""
    a = F.regexp_replace(F.lower(T.trim(F.coalesce(action, F.lit("")))), r"\.\z", "")
    return (
        F.when(kind == "Notice", "notice")
        .when(a.contains("rehearing"), "amended")
        .when(a.contains("notice of proposed rulemaking") | a.startswith("proposed rule"), "proposed")
        .when(a.startswith("final rule") | a.startswith("final order"), "final")
        .when(kind == "Proposed Rule", "proposed")
        .otherwise("final")
    )


def provision_status(status: Column, disposition: Column, changed: Column) -> Column:
    return (
        F.when(disposition == "unclassified", "unknown")
        .when(status == "notice", "unknown")
        .when(status == "proposed", "proposed")
        .when(status == "final", "adopted")
        .when(status != "amended", "unknown")
        .when(disposition.isNull(), F.when(changed, "adopted").otherwise("unknown"))
        .when(disposition.isin("affirmed", "sustained", "clarified"), "settled")
        .when(disposition == "modified", "adopted")
        .when(disposition == "set-aside", "reopened")
        .otherwise("unknown")
    )


def confidence(by_rule: Column, agree: Column, model: Column, foreign: Column, threshold: float = V.CONFIDENT) -> Column:
    """level and escalated. agree and model are null where unknown."""
    low = F.coalesce(foreign, F.lit(False)) | F.coalesce(~agree, F.lit(False))
    high = by_rule | F.coalesce(agree, F.lit(False))
    level = F.when(low, "low").when(high, "high").when(model < threshold, "low").otherwise("medium")
    return F.struct(level.alias("level"), (level == "low").alias("escalated"))


def category(changed: Column, title: Column) -> Column:
    """What a changed text is about: the title settles definitions, else the first list with a signal."""
    out = F.when(T.matches(F.coalesce(title, F.lit("")), V.DEFINITION_TITLE), "definition")
    for name in V.SIGNAL_ORDER:
        out = out.when(has_signal(changed, name), name)
    return out.otherwise("other")


def has_signal(text: Column, name: str) -> Column:
    return any_of(T.matches(text, p) for p in V.SIGNALS[name])


def strongest_signal(text: Column, name: str) -> Column:
    """Where the first pattern of the list that matches does so, from 0; null without any."""
    return F.coalesce(*(T.search(text, p) for p in V.SIGNALS[name]))


def category_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.CATEGORIES)), c)


def is_administrative(title: Column) -> Column:
    bare = T.trim(T.replace(title, V.ENUMERATOR, ""))
    return any_of(T.matches(bare, f"(?i){p}") for p in V.ADMINISTRATIVE)


def heading_level(source: Column) -> Column:
    return F.expr("null").cast("int") if source is None else F.nullif(F.regexp_extract(source, r"^HD([0-9])\z", 1), F.lit("")).cast("int")


def provision_number(heading: Column) -> Column:
    return T.extract(heading, V.PROVISION)


def is_provision_ref(ref: Column) -> Column:
    return ref.contains(".") | F.coalesce(ref.try_cast("double") < 100, F.lit(False))


def cross_refs(text: Column) -> Column:
    """Distinct references in order of first mention."""
    return F.array_distinct(T.extract_all(text, V.CROSSREF, 1))


def sentences(text: Column) -> Column:
    return F.split(text, T.pattern(V.SENTENCE_END))


def directive_refs(text: Column) -> Column:
    """References in sentences by which the agency directs a change."""
    said = F.filter(sentences(text), lambda s: T.matches(s, V.DIRECTIVE) & ~T.matches(s, V.DECLINING))
    return F.array_distinct(F.flatten(F.transform(said, cross_refs)))


def defined_terms(text: Column) -> Column:
    """Capitalised phrases of two words at least, without a leading article, lower-cased."""
    found = F.transform(T.extract_all(text, V.TERM), lambda x: F.regexp_replace(T.trim(x), rf"^(?:The|A|An){T.WS}+", ""))
    return F.array_distinct(F.transform(F.filter(found, lambda x: T.matches(x, "[WS]")), F.lower))


def overlap(a: Column, b: Column) -> Column:
    """Shared terms by the smaller set's size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def count_of(raw: Column, words: dict[str, int]) -> Column:
    values = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(raw.try_cast("int"), F.try_element_at(values, F.lower(raw)))


def add_period(day: Column, count: Column, unit: Column) -> Column:
    """A date plus days, months or years; a day that the month lacks runs over into the next month."""
    months = F.when(unit == "years", count * 12).otherwise(count)
    over = F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)
    return F.when(unit == "days", F.date_add(day, count)).otherwise(over)


def anchor(sentence: Column) -> Column:
    return (
        F.when(T.matches(sentence, V.ANCHOR_PUBLICATION), "publication").when(T.matches(sentence, V.ANCHOR_EFFECTIVE), "effective").otherwise("unstated")
    )


def resolve_input(raw: Column) -> Column:
    """What a typed source names: kind (document or docket) and value, or an error."""
    t = T.trim(F.coalesce(raw, F.lit("")))
    web = T.matches(t, r"(?i)^https?://")
    host = F.try_parse_url(t, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(t, F.lit("PATH")), F.lit(""))
    own = T.matches(F.coalesce(host, F.lit("")), r"(?i)(^|\.)federalregister\.gov\z")
    number = F.nullif(F.regexp_extract(path, r"([0-9]{4}-[0-9]{4,6})(?:\.xml|\.txt)?(?:/|\z)", 1), F.lit(""))
    document = F.when(web, F.when(own, number)).when(T.matches(t, r"^[0-9]{4}-[0-9]{4,6}\z"), t)
    docket = F.when(~web & document.isNull() & T.matches(t, r"^[A-Za-z]{1,6}[-0-9][A-Za-z0-9_-]*\z"), F.upper(t))
    error = F.lit("unsupported source: give a federalregister.gov document URL, a document number or a docket")
    return F.struct(
        F.when(document.isNotNull(), "document").when(docket.isNotNull(), "docket").alias("kind"),
        F.coalesce(document, docket).alias("value"),
        F.when(document.isNull() & docket.isNull(), error).alias("error"),
    )


def json_salvage(raw: Column) -> Column:
    """The JSON in an answer, as a variant: fenced or whole, else the outermost object or array, else null."""
    t = T.trim(raw)
    fenced = F.nullif(F.regexp_extract(t, rf"```(?:json)?{T.WS}*([\s\S]*?)```", 1), F.lit(""))
    body = T.trim(F.coalesce(fenced, t))
    outer = F.nullif(F.regexp_extract(body, r"[\[{][\s\S]*[\]}]", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(outer))


def label(kind: str, key: Column) -> Column:
    """What readers see for a key of one of the vocabulary's sets of labels; null for an unknown key."""
    pairs = F.create_map(*[F.lit(x) for kv in V.LABELS[kind].items() for x in kv])
    return F.try_element_at(pairs, key)


def official_url(url: Column, number: Column) -> Column:
    """The document's own page, or the one that its number gives."""
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit(V.OFFICIAL_URL), number))
