"""Column expressions over text: tokens, folded forms, facts, ids. All stay in the JVM.

Nulls give null or empty arrays as each docstring says. ``lower`` plus the German sharp s stands for case folding;
final sigma, ligatures and the dotted capital I fold differently elsewhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def _without_marks() -> tuple[str, str]:
    """Every composed character of the basic plane whose decomposition is one base character and marks."""
    pairs = []
    for code in range(0xC0, 0xFFFF):
        if 0xAC00 <= code < 0xE000:
            continue
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if unicodedata.normalize("NFD", c) != c and len(base) == 1:
            pairs.append((c, base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_COMPOSED, _BASES = _without_marks()
#: For ``str.translate``, where text is folded in Arrow batches.
BASE_OF = str.maketrans(_COMPOSED, _BASES)


def case_folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fold(text: Column) -> Column:
    """Case-folded without diacritics; đ becomes d. Null stays null."""
    bare = F.regexp_replace(F.translate(case_folded(text), _COMPOSED, _BASES), r"\p{Mn}+", "")
    return F.translate(bare, "đ", "d")


def token_line(text: Column) -> Column:
    """Case-folded words (runs of letters, digits and _) in order with one space between, perhaps one before and behind them."""
    return F.regexp_replace(case_folded(text), r"[^\p{L}\p{N}_]+", " ")


def tokens(text: Column) -> Column:
    """The words of ``token_line``, with repeats; null gives an empty array."""
    words = F.split(token_line(text), " ")
    return F.coalesce(F.filter(words, lambda t: t != ""), F.array().cast("array<string>"))


def content_tokens(text: Column, stopwords: Iterable[str] = (), min_len: int = 2, digits: bool = True) -> Column:
    """Distinct tokens of at least ``min_len`` characters, without stop words and, if asked, without numbers."""
    stop = F.array(*(F.lit(s) for s in stopwords)).cast("array<string>")
    kept = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= min_len) & ~F.array_contains(stop, t))
    return kept if digits else F.filter(kept, lambda t: ~t.rlike(r"^\p{N}+$"))


def codes(text: Column) -> Column:
    """Distinct whole tokens that are one to six letters and one to four digits, or seven digits; sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: t.rlike(r"^(?:[a-z]{1,6}\d{1,4}|\d{7})$"))))


def years(text: Column) -> Column:
    """struct(values, kind): the years 1900 to 2199 written as four digits; kind missing, single, multi or academic_range."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20|21)\d{2})(?!\d)"), 1), lambda y: y.cast("int"))))
    found = F.coalesce(found, F.array().cast("array<int>"))
    ranges = F.regexp_extract_all(text, F.lit(r"((?:19|20|21)\d{2}\s*[-–—/]\s*(?:19|20|21)\d{2})"), 1)
    ends = F.transform(F.regexp_extract_all(F.get(ranges, F.lit(0)), F.lit(r"(\d{4})"), 1), lambda y: y.cast("int"))
    is_range = (F.size(found) == 2) & (F.size(ranges) == 1) & (F.get(ends, F.lit(1)) == F.get(ends, F.lit(0)) + 1)
    kind = F.when(F.size(found) == 0, "missing").when(F.size(found) == 1, "single").when(F.coalesce(is_range, F.lit(False)), "academic_range").otherwise("multi")
    return F.struct(found.alias("values"), kind.alias("kind"))


def labels_by_alias(text: Column, aliases: dict[str, str]) -> Column:
    """Sorted labels whose pattern (a regular expression on folded text) occurs, such as campuses by their names."""
    folded = F.coalesce(fold(text), F.lit(""))
    found = F.array(*(F.when(folded.rlike(pattern), F.lit(label)) for label, pattern in sorted(aliases.items())))
    return F.filter(found, lambda x: x.isNotNull()).cast("array<string>")


def normalized_space(text: Column) -> Column:
    """Case-folded, each run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(case_folded(text), r"\s+", " "))


def normalized_markdown(text: Column) -> Column:
    """Without backslash, star, underscore and backtick, then as normalized_space."""
    return normalized_space(F.translate(text, "\\*_`", ""))


def slug(text: Column, longest: int = 90) -> Column:
    """Folded ASCII words joined by hyphens."""
    bare = F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(bare, 1, longest), r"-+$", "")


def document_id(namespace: Column, year: Column, category: Column, title: Column, version: Column, page: Column | None = None) -> Column:
    """namespace-year-category-slug-vN, with -pNNN for a page."""
    base = F.concat_ws("-", namespace, year.cast("string"), category, slug(title), F.concat(F.lit("v"), version.cast("string")))
    return base if page is None else F.when(page.isNull(), base).otherwise(F.concat(base, F.format_string("-p%03d", page)))


def joined_digest(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts joined by U+001F; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 24)


def stable_chunk_id(doc_id: Column, chunk_type: Column, page: Column, heading: Column, parent_id: Column, ordinal: Column, content: Column) -> Column:
    return joined_digest(doc_id, chunk_type, page, heading, parent_id, ordinal, content)


def uuid5(name: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """A name-based UUID, version 5 (RFC 4122); the default namespace is DNS."""
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    digest = F.sha1(raw)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def point_id(name: Column) -> Column:
    """A UUID as it is, anything else as its name-based UUID."""
    return F.when(F.lower(name).rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(name)).otherwise(uuid5(name))


def expand_abbreviations(text: Column, expansions: dict[str, str]) -> Column:
    """Write each abbreviation's expansion after it, once: "abc" becomes "abc (Expansion)"; longest first, whole tokens."""
    for short in sorted(expansions, key=lambda s: (-len(s), s)):
        full = expansions[short]
        quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in full)
        pattern = rf"(?iU)(?<![\p{{L}}\p{{N}}_])({short})(?![\p{{L}}\p{{N}}_])(?!\s*\(\s*{quoted}\s*\))"
        text = F.regexp_replace(text, pattern, "$1 (" + full.replace("\\", "\\\\").replace("$", "\\$") + ")")
    return text


#: Words that hyphens, dots and slashes may join, numbers, and quoted parts.
JOINED_WORD = r"[\p{L}\p{N}]+(?:[-./][\p{L}\p{N}]+)*"
PLAIN_NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)*(?![\p{L}\p{N}_])"
QUOTED_PART = "[\"“”']([^\"“”']+)[\"“”']"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def joined_words(text: Column) -> Column:
    """Distinct case-folded words, parts joined by hyphen, dot or slash kept together; null gives an empty array."""
    return F.array_distinct(F.transform(_all(text, JOINED_WORD), case_folded))


def protected_terms(text: Column, abbreviations: Iterable[str] = ()) -> Column:
    """Sorted distinct terms that a rewrite may not lose: numbers, words all in capitals (two letters or digits at least), words of
    letters and digits, known abbreviations, and the words of quoted parts; case-folded."""
    words, known = _all(text, JOINED_WORD), F.array(*(F.lit(a.lower()) for a in abbreviations)).cast("array<string>")

    def kept(word: Column) -> Column:
        bare = F.regexp_replace(word, "[-./]", "")
        letter = bare.rlike(r"\p{L}")
        capitals = (F.length(bare) >= 2) & bare.rlike(r"\p{Lu}") & ~bare.rlike(r"\p{Ll}")
        return F.array_contains(known, case_folded(word)) | (letter & (capitals | bare.rlike(r"\d")))

    quoted = F.flatten(F.transform(_all(text, QUOTED_PART, 1), lambda q: F.regexp_extract_all(q, F.lit(JOINED_WORD), F.lit(0))))
    every = F.concat(_all(text, PLAIN_NUMBER), F.filter(words, kept), quoted)
    return F.array_sort(F.array_distinct(F.transform(every, case_folded)))


def facts(text: Column) -> Column:
    """Sorted distinct facts of a question: numbers, all-capital words, words of letters and digits, quoted words."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(\d+(?:[.,:/-]\d+)*)(?![\p{L}\p{N}_])"), 1)
    capitals = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(\p{Lu}{2,})(?![\p{L}\p{N}_])"), 1)
    mixed = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])((?=\w*\p{L})(?=\w*\d)\w+)(?![\p{L}\p{N}_])"), 1)
    quoted = F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[\"“]([^\"”]+)[\"”]"), 1), tokens))
    every = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (numbers, capitals, mixed, quoted)))
    return F.array_sort(F.array_distinct(F.transform(every, case_folded)))


def numeric_token_count(text: Column) -> Column:
    """Numbers that stand alone, with inner . , : / - allowed."""
    return F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])\d+(?:[.,:/-]\d+)*(?![\p{L}\p{N}_])"))


def markdown_cells(line: Column) -> Column:
    """The trimmed cells of a pipe-table row, pipes unescaped."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def scalar_kind(raw: Column) -> Column:
    """How a frontmatter scalar reads: json_string, int, bool, null or string."""
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), "null")
        .when(F.trim(raw).rlike(r'^".*"$'), "json_string")
        .when(F.trim(raw).rlike(r"^-?\d+$"), "int")
        .when(F.lower(F.trim(raw)).isin("true", "false"), "bool")
        .otherwise("string")
    )


def parsed_scalar(raw: Column) -> Column:
    """A frontmatter scalar as struct (kind, text, number, truth): the field of its kind is set, of a null none.

    A text in quotes is read as JSON where it is JSON, else it stays as it stands.
    """
    kind, bare = scalar_kind(raw), F.trim(raw)
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), bare, F.lit("}")), "$.v")
    text = F.when(kind == "json_string", F.coalesce(quoted, bare)).when(kind == "string", bare)
    return F.struct(kind.alias("kind"), text.alias("text"), F.when(kind == "int", bare.try_cast("decimal(38,0)")).alias("number"), F.when(kind == "bool", F.lower(bare) == "true").alias("truth"))


def url_host(url: Column) -> Column:
    """The host of an address in lower case, null if it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def question_hash(question: Column) -> Column:
    """SHA-256 of a question, to log it without its text."""
    return F.sha2(question, 256)


def valid_vector(v: Column, dim: int | None = None) -> Column:
    """Whether a vector is finite, not all zero and of the right length; false for null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = finite & F.exists(v, lambda x: x != 0) & ((F.size(v) == dim) if dim else F.size(v) > 0)
    return F.coalesce(ok, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for a zero or non-finite vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def canonical_map(m: Column) -> Column:
    """A map as JSON with sorted keys, so that key order is no difference."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
