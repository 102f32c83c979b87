"""The rule tier: whether a revision is editorial or material, by the first rule that fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators.spans import once

# The rules in order, each with its outcome and reason.
RULES = {
    "whitespace-only": ("editorial", "Whitespace only; the wording is unchanged."),
    "case-only": ("editorial", "Capitalisation only; the wording is unchanged."),
    "article-only": ("editorial", "Article change only (a / an / the)."),
    "typographic-convention": ("editorial", "Only tokens that convention sets in italics."),
    "cross-reference-renumber": ("editorial", "A cross-reference was renumbered; its target's duty is unchanged."),
    "negation-change": ("material", "A negation was added or removed."),
    "modal-change": ("material", "A modal verb changed."),
    "numeric-change": ("material", "A numeric value changed."),
    "none": ("undecided", "No rule applies; judgement is needed."),
}


def masked(text: Column) -> Column:
    """Cross-references as one token, so that a renumbering changes no number."""
    return T.replace(text, V.CROSSREF_NUMBER, "§REF")


def numeric_values(text: Column) -> Column:
    """The distinct values that a text names in digits or words, sorted."""
    digits = F.transform(T.extract_all(text, V.NUMBERS), lambda x: F.regexp_replace(x, "[^0-9.]", "").try_cast("double"))
    values = F.create_map(*[F.lit(x) for w, n in V.NUMBER_WORD_VALUES.items() for x in (w, float(n))])
    words = F.transform(T.extract_all(text, V.NUMBER_WORDS), lambda x: F.try_element_at(values, F.lower(x)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(digits, words), lambda x: x.isNotNull())))


def rule_of(before: Column, after: Column, edits: Column) -> Column:
    """The id of the first rule that fires. edits: array of structs with kind and text."""
    return _rule_of(T.collapse(before), T.collapse(after), edits)


def _rule_of(before: Column, after: Column, edits: Column) -> Column:
    """As rule_of(), of texts whose white space is collapsed: no rule tells one white space from another."""

    def both(f) -> Column:
        return f(before) == f(after)

    def bare(x: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(T.replace(x, V.ARTICLES, " "), " {2,}", " ")))

    typographic = (F.size(edits) > 0) & F.forall(edits, lambda e: (e["kind"] == "addition") & F.lower(T.trim(e["text"])).isin(*V.TYPOGRAPHIC))
    return (
        F.when(before == after, "whitespace-only")
        .when(both(F.lower), "case-only")
        .when(both(bare), "article-only")
        .when(typographic, "typographic-convention")
        .when(both(lambda x: F.lower(masked(x))), "cross-reference-renumber")
        .when(~both(lambda x: T.sorted_words(x, V.NEGATION)), "negation-change")
        .when(~both(lambda x: T.sorted_words(x, V.MODALS)), "modal-change")
        .when(~both(lambda x: numeric_values(masked(x))), "numeric-change")
        .otherwise("none")
    )


def _by_rule(rule: Column, at: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[at])]), rule)


def classified(revisions: DataFrame) -> DataFrame:
    """Adds rule_id, materiality and reason."""
    out = once(revisions, __b=T.collapse("before"), __a=T.collapse("after"))
    out = once(out, rule_id=_rule_of(F.col("__b"), F.col("__a"), F.col("edits"))).drop("__b", "__a")
    return out.withColumns({"materiality": _by_rule(F.col("rule_id"), 0), "reason": _by_rule(F.col("rule_id"), 1)})


def funnel(classified: DataFrame) -> DataFrame:
    """One row per document: edits and revisions by materiality, and the share of edits that rules decided (0 without any)."""
    n = F.size("edits")
    counts = [F.sum(F.when(F.col("materiality") == m, n).otherwise(0)).alias(f"edits_{m}") for m in V.MATERIALITIES]
    counts += [F.count_if(F.col("materiality") == m).alias(f"revisions_{m}") for m in V.MATERIALITIES]
    out = classified.groupBy("doc_id").agg(F.sum(n).alias("edits"), F.count("*").alias("revisions"), *counts)
    decided = F.col("edits") - F.col("edits_undecided")
    return out.withColumn("rule_coverage", F.when(F.col("edits") > 0, decided / F.col("edits")).otherwise(F.lit(0.0)))


def by_rule(classified: DataFrame) -> DataFrame:
    """doc_id, rule_id, revisions."""
    return classified.groupBy("doc_id", "rule_id").agg(F.count("*").alias("revisions"))
