"""Scope rules as column expressions: which years, places and subjects a query asks for and a source covers.

The vocabulary is a parameter. Only a source's metadata and headings establish its scope, never its body.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import codes, fold, labels_by_alias, years


@dataclass(frozen=True)
class Vocabulary:
    """Names that the rules look for, as regular expressions on folded text."""

    places: dict[str, str] = field(default_factory=dict)
    #: intent -> pattern that asks for it; tried in order, else ``default_intent``.
    intents: dict[str, str] = field(default_factory=dict)
    default_intent: str = "general"
    #: intent -> pattern of headings that serve it.
    sections: dict[str, str] = field(default_factory=dict)
    #: headings that serve none of ``strict_intents``.
    off_topic: str = r"$^"
    strict_intents: tuple[str, ...] = ()
    #: intents for which an unknown place excludes.
    place_required: tuple[str, ...] = ()


PROVENANCE = ("source_url", "source_file", "raw_file", "version", "content_hash", "admission_year", "academic_year")


def text_of(*columns: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def with_scope(queries: DataFrame, vocabulary: Vocabulary, query_col: str = "query") -> DataFrame:
    """Add q_years, q_places, q_codes and q_intent."""
    q = F.col(query_col)
    folded = F.coalesce(fold(q), F.lit(""))
    intent = F.lit(vocabulary.default_intent)
    for name, pattern in reversed(vocabulary.intents.items()):
        intent = F.when(folded.rlike(pattern), name).otherwise(intent)
    return queries.withColumns({"q_years": years(q), "q_places": labels_by_alias(q, vocabulary.places), "q_codes": codes(q), "q_intent": intent})


def source_years(requested: Column) -> Column:
    """The years of a source: the first of its year fields that names any; the requested kind decides which is asked first."""
    admission, academic, year, title = (years(F.col(c).cast("string")) for c in ("admission_year", "academic_year", "year", "title"))
    some = lambda y: F.when(F.size(y["values"]) > 0, y)
    none = F.struct(F.array().cast("array<int>").alias("values"), F.lit("missing").alias("kind"))
    academic_first = F.coalesce(some(academic), some(admission), some(year), some(title), none)
    return F.when(requested["kind"] == "academic_range", academic_first).otherwise(F.coalesce(some(admission), some(academic), some(year), some(title), none))


def source_places(vocabulary: Vocabulary) -> Column:
    """The places of a source: explicit labels, narrowed by its nearest heading that names one; else heading, else title."""
    explicit = text_of(F.col("campus"), F.col("campus_code"), F.col("campuses"))
    known = labels_by_alias(explicit, vocabulary.places)
    some = lambda a: F.when(F.size(a) > 0, a)
    path = F.concat_ws(" ", F.col("heading_path"))
    none = F.array().cast("array<string>")
    local = F.coalesce(*(some(labels_by_alias(c, vocabulary.places)) for c in (F.col("heading"), path, F.col("section"))), none)
    narrowed = F.when((F.size(local) > 0) & (F.size(F.array_except(local, known)) == 0), local).otherwise(known)
    return F.when(F.trim(explicit) != "", narrowed).otherwise(F.coalesce(some(local), labels_by_alias(F.col("title"), vocabulary.places)))


def factor(name: str, value: float) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))


def assess(pairs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add s_years, s_places, eligible, factors, ambiguities and exclusions to rows of a query's scope with a chunk."""
    pairs = pairs.withColumn("s_years", source_years(F.col("q_years"))).withColumn("s_places", source_places(vocabulary))
    q, s = F.col("q_years"), F.col("s_years")
    asked, answered = F.size(q["values"]) > 0, F.size(s["values"]) > 0
    q_range, s_range = q["kind"] == "academic_range", s["kind"] == "academic_range"
    start = lambda y: F.array_min(y["values"])
    # one branch of the years' rule holds; the order of the branches is part of the rule
    branch = (
        F.when(~asked, F.lit(None))
        .when(~answered, "year_missing")
        .when(q_range & s_range, F.when(q["values"] == s["values"], "academic_range").otherwise("wrong_academic_range"))
        .when((q["kind"] == "single") & s_range, F.when(F.array_contains(q["values"], start(s)), "academic_start").otherwise("wrong_admission_year"))
        .when(q_range & (s["kind"] == "single") & ~F.array_contains(s["values"], start(q)), "wrong_academic_start")
        .when(~F.arrays_overlap(q["values"], s["values"]), "wrong_year")
        .otherwise("year_match")
    )
    wants_place, has_place = F.size("q_places") > 0, F.size("s_places") > 0
    required = F.col("q_intent").isin(*vocabulary.place_required) if vocabulary.place_required else F.lit(False)
    place = (
        F.when(wants_place & ~has_place, "campus_missing")
        .when(wants_place & ~F.arrays_overlap("s_places", "q_places"), "wrong_campus")
        .when(wants_place, "campus_match")
        .when(~has_place & required, "campus_unspecified")
    )
    heading = F.coalesce(fold(text_of(F.col("heading"), F.concat_ws(" ", "heading_path"), F.col("section"), F.col("title"))), F.lit(""))
    section = F.lit(False)
    for intent, pattern in vocabulary.sections.items():
        section = section | ((F.col("q_intent") == intent) & heading.rlike(pattern))
    strict = F.col("q_intent").isin(*vocabulary.strict_intents) if vocabulary.strict_intents else F.lit(False)
    coded = F.arrays_overlap(F.col("q_codes"), codes(text_of(F.col("content"), heading)))
    pairs = pairs.withColumns({"__branch": branch, "__place": place, "__section": section, "__off": ~section & strict & heading.rlike(vocabulary.off_topic), "__coded": F.coalesce(coded, F.lit(False))})
    b, p = F.col("__branch"), F.col("__place")
    factors = F.array(
        F.when(b == "year_missing", factor("year_unknown", 0.8)).when(b == "academic_range", factor("academic_range", 1.25)).when(b == "academic_start", factor("academic_start", 1.1)).when(b == "year_match", factor("year_match", 1.25)),
        F.when(p == "campus_missing", factor("campus_unknown", 0.8)).when(p == "campus_match", factor("campus_match", 1.2)),
        F.when(F.col("__section"), factor("section_match", 1.5)).when(F.col("__off"), factor("curriculum_section", 0.5)),
        F.when(F.col("__coded"), factor("exact_entity_code", 1.8)),
    )
    ambiguities = F.array(F.when(b == "year_missing", "year_missing").when((b == "year_match") & q_range, "academic_range_unconfirmed"), F.when(p.isin("campus_missing", "campus_unspecified"), p))
    exclusions = F.array(F.when(b.startswith("wrong_"), b), F.when(p == "wrong_campus", p).when((p == "campus_missing") & required, "cutoff_campus_unconfirmed"))
    present = lambda a: F.filter(a, lambda x: x.isNotNull())
    out = pairs.withColumns({"factors": present(factors), "ambiguities": present(ambiguities), "exclusions": present(exclusions)})
    return out.withColumn("eligible", F.size("exclusions") == 0).drop("__branch", "__place", "__section", "__off", "__coded")


def factor_product(factors: Column, least: float = 0.25, most: float = 4.0) -> Column:
    """The product of the factors' values, kept between the bounds."""
    product = F.aggregate(factors, F.lit(1.0), lambda a, x: a * x["value"])
    return F.least(F.lit(most), F.greatest(F.lit(least), product))


def same_scope(seed: str, candidate: str) -> Column:
    """Whether a chunk may be added beside a seed: same document, same provenance, same years and places.

    ``seed`` and ``candidate`` are prefixes of the two sides' columns.
    """
    a, b = (lambda n: F.col(f"{seed}{n}")), (lambda n: F.col(f"{candidate}{n}"))
    ok = a("doc_id").isNotNull() & (a("doc_id") == b("doc_id"))
    for name in (*PROVENANCE, "s_years", "s_places"):
        ok = ok & a(name).eqNullSafe(b(name))
    proven = ((F.size("q_years.values") == 0) | (F.size(a("s_years")["values"]) > 0)) & ((F.size("q_places") == 0) | (F.size(a("s_places")) > 0))
    return ok & proven & b("eligible")
