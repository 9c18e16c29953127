"""Scalar functions of the annotation formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = ["", "-", "NA", "na", "None", "."]
_ESCAPES = [("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")]


def percent_decode(text: Column) -> Column:
    """%XX becomes its byte; a plus stays a plus, and a bad escape stays as it is."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), "\\+", "%2B")
    return F.when(F.contains(text, F.lit("%")), F.try_url_decode(safe)).otherwise(text)


def percent_escape(text: Column) -> Column:
    """The characters that column 9 reserves, the percent sign first."""
    out = text
    for plain, escaped in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.when(text.rlike("[%;=&,\t\n\r]"), out).otherwise(text)


def score_text(score: Column) -> Column:
    """Six significant digits without trailing zeros, a dot for null.  Ties, in the
    shortest decimal form of the number, go up."""
    mag = F.floor(F.log10(F.abs(score)))
    digits = F.least(F.greatest(5 - mag, F.lit(0)), F.lit(10))
    by_digits = F.element_at(F.array(*[F.format_string(f"%.{i}f", score) for i in range(11)]), (digits + 1).cast("int"))
    trimmed = F.when(F.contains(by_digits, F.lit(".")), F.regexp_replace(F.regexp_replace(by_digits, "0+$", ""), "\\.$", "")).otherwise(by_digits)
    exp = F.format_string("%.5e", score)
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(exp, "^([^e]+)e", 1), "0+$", ""), "\\.$", "")
    scientific = F.concat(mantissa, F.regexp_extract(exp, "(e[+-][0-9]+)$", 1))
    return F.when(score.isNull(), ".").when(score == 0, "0").when((mag < -4) | (mag >= 6), scientific).otherwise(trimmed)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def parse_attributes(column9: Column) -> Column:
    """Column 9 as array<struct<key, values>>: split, then decode; first '=' parts key
    from value; repeated keys are joined in order of first appearance; '.' and '' are none."""
    chunks = F.filter(F.transform(F.split(column9, ";"), lambda x: F.trim(x)), lambda c: c != "")
    pairs = F.transform(
        F.when(F.coalesce(F.trim(column9), F.lit(".")) == ".", F.array().cast("array<string>")).otherwise(chunks),
        lambda c: F.struct(
            percent_decode(F.trim(F.substring_index(c, "=", 1))).alias("key"),
            F.transform(F.split(F.substr(c, F.instr(c, "=") + 1), ","), lambda v: percent_decode(v)).alias("values"),
        ),
    )

    def merged(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        together = F.transform(keys, lambda k: F.struct(k.alias("key"), F.flatten(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["values"])).alias("values")))
        return F.when(F.size(keys) == F.size(pairs), pairs).otherwise(together)

    return _let(pairs, merged)


def attribute_without_value(column9: Column) -> Column:
    """A chunk of column 9 that has no '='."""
    chunks = F.filter(F.transform(F.split(column9, ";"), lambda x: F.trim(x)), lambda c: c != "")
    return (F.coalesce(F.trim(column9), F.lit(".")) != ".") & F.exists(chunks, lambda c: ~F.contains(c, F.lit("=")))


def all_values(attributes: Column, key: str) -> Column:
    """All values of the first attribute of that name, whatever its case; empty if none."""
    found = F.filter(attributes, lambda a: F.lower(a["key"]) == key.lower())
    return F.coalesce(F.get(found, F.lit(0))["values"], F.array().cast("array<string>"))


def first_value(attributes: Column, key: str) -> Column:
    """The first value of the first non-empty attribute of that name."""
    found = F.filter(attributes, lambda a: (F.lower(a["key"]) == key.lower()) & (F.size(a["values"]) > 0))
    return F.get(F.get(found, F.lit(0))["values"], F.lit(0))


def exemption(attributes: Column, flags: list[str], false_values: list[str]) -> Column:
    """The first flag, in the order given, that is present with a value that isn't false."""
    out = F.lit(None).cast("string")
    for flag in reversed(flags):
        on = F.exists(attributes, lambda a: (F.lower(a["key"]) == flag) & F.exists(a["values"], lambda v: ~F.lower(F.trim(v)).isin(false_values)))
        out = F.when(on, flag).otherwise(out)
    return out


def prefixed(prefix: str | None, name: Column) -> Column:
    return F.concat(F.lit(prefix), name) if prefix else name


def clean(text: Column) -> Column:
    """None of the placeholders for an empty value."""
    return F.when(~F.trim(text).isin(EMPTY), F.trim(text))


def is_evalue(score: Column) -> Column:
    return F.coalesce((score > 0) & (score < 0.01), F.lit(False))


def term_variants(term: Column) -> Column:
    """The forms in which a term may be stored."""
    bare = F.regexp_replace(term, "(?i)^(GO|EC|ko):", "")
    return F.array_distinct(
        F.array_compact(
            F.array(
                term,
                F.when(term.rlike("^[0-9]{7}$"), F.concat(F.lit("GO:"), term)),
                F.when(term.rlike("(?i)^EC:"), bare),
                F.when(term.rlike("^[0-9]+\\.[0-9-]+\\.[0-9-]+\\.[0-9n-]+$"), F.concat(F.lit("EC:"), term)),
                F.when(term.rlike("^K[0-9]{5}$"), F.concat(F.lit("ko:"), term)),
                F.when(term.rlike("^ko:K[0-9]{5}$"), bare),
                F.when(term.rlike("^map[0-9]+$"), F.concat(F.lit("ko"), F.substr(term, F.lit(4)))),
            )
        )
    )


def kegg_pathways(terms: Column) -> Column:
    """mapN is koN; a mapN beside its koN is left out."""
    kept = F.filter(terms, lambda x: ~(x.rlike("^map[0-9]+$") & F.array_contains(terms, F.concat(F.lit("ko"), F.substr(x, F.lit(4))))))
    return F.transform(kept, lambda x: F.regexp_replace(x, "^map([0-9]+)$", "ko$1"))


def slug(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("._-")))


def attribute_digest(attributes: Column) -> Column:
    """SHA-1 of sorted keys with their sorted distinct values, without ID and Parent."""
    kept = F.filter(attributes, lambda a: ~a["key"].isin("ID", "Parent"))
    lines = F.transform(kept, lambda a: F.concat(a["key"], F.lit("\x1f"), F.array_join(F.array_sort(F.array_distinct(a["values"])), "\x1f")))
    return F.sha1(F.array_join(F.array_sort(lines), "\x1e"))


def anonymous_key(*columns: Column) -> Column:
    """Key of a feature without an ID."""
    return F.substring(F.sha1(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])), 1, 24)


def segments_text(segments: Column) -> Column:
    """Sorted "start-end" list of an array of (start, end)."""
    return F.array_join(F.transform(F.array_sort(segments), lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


def parse_segments(text: Column) -> Column:
    return F.transform(
        F.filter(F.split(text, ","), lambda s: s != ""),
        lambda s: F.struct(F.split(s, "-")[0].cast("long").alias("start"), F.split(s, "-")[1].cast("long").alias("end")),
    )


def location_spans(location: Column) -> Column:
    """(start, end) pairs of a feature-table location, in order; partial marks are dropped."""
    starts = F.regexp_extract_all(location, F.lit("<?([0-9]+)(?:\\.\\.>?([0-9]+))?"), F.lit(1))
    ends = F.regexp_extract_all(location, F.lit("<?([0-9]+)(?:\\.\\.>?([0-9]+))?"), F.lit(2))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("long").alias("start"), F.when(e == "", s).otherwise(e).cast("long").alias("end")))


def location_strand(location: Column) -> Column:
    """'-' for a complement; null where complements are nested or mixed."""
    n = F.size(F.split(location, "complement\\(")) - 1
    whole = F.startswith(location, F.lit("complement("))
    spans = F.size(location_spans(location))
    return F.when(n == 0, "+").when((n == 1) & (whole | (spans == 1)), "-").when(~whole & (n == spans), "-")


def region_parts(text: Column) -> Column:
    """(name, start, end) of "name:start-end" or "name:start"; commas are ignored."""
    pattern = "^(.*):([0-9,]+)(?:-([0-9,]+))?$"
    number = lambda i: F.replace(F.regexp_extract(text, pattern, i), F.lit(","), F.lit("")).try_cast("long")
    hit = text.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("name"),
        F.when(hit, number(2)).alias("start"),
        F.when(hit, F.coalesce(number(3), number(2))).alias("end"),
    )


def strict_int(text: Column) -> Column:
    """A whole number where the text is one and nothing else; null for placeholders and all other text."""
    t = clean(text)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("long"))


def number(text: Column) -> Column:
    """A number where the text is one; null for placeholders and all other text."""
    return clean(text).try_cast("double")
