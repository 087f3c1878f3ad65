"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing source, medium or campaign.
PLACEHOLDERS = ("", "(not set)", "(not provided)", "(data deleted)", "<other>", "unknown")
# The characters with Unicode's White_Space property.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(c, F.lit(WHITE_SPACE))


def text(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(trim(c), F.lit(""))


def placeholder_null(c: Column) -> Column:
    return F.when(~F.lower(trim(c)).isin(*PLACEHOLDERS), trim(c))


# A host with or without a scheme, a user and a port; what follows it starts with one of ``/:?#``.
HOST = r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^/@?#]*@)?([^/:?#@\s]+)(?:[/:?#].*)?$"
# A host of at least two labels, none empty; not an IPv4 address, whose last label is a number.
REGISTRABLE = r"^([^.]+\.)+[^.]*[^0-9.][^.]*$"


def url_host(c: Column) -> Column:
    """Lower-case host of a URL, without user and port; null where there is none or blanks stand in it."""
    return F.nullif(F.regexp_extract(F.lower(c), HOST, 1), F.lit(""))


def suffix_depths(suffixes: tuple[str, ...]) -> list[tuple[int, list[str], list[str], list[str]]]:
    """(labels, suffixes, parents of a wildcard, exceptions) by number of labels, longest first."""
    by: dict[int, tuple[list[str], list[str], list[str]]] = {}
    for rule in sorted(set(suffixes)):
        kind = 1 if rule.startswith("*.") else 2 if rule.startswith("!") else 0
        by.setdefault(rule.count(".") + 1, ([], [], []))[kind].append(rule[(0, 2, 1)[kind] :])
    return [(n, *by[n]) for n in sorted(by, reverse=True)]


def reg_domain(host: Column, suffixes: tuple[str, ...]) -> Column:
    """The host's public suffix and the label before it; null for a suffix alone, one label or an IP address.

    Of the rules that match, an exception wins (its suffix lacks its first label), then the longest; without one the
    top-level domain is the suffix.  Look-ups are in sets of literals, so a rule more costs nothing a row.
    """
    tail = lambda n: F.substring_index(host, ".", -n)
    labels = F.size(F.split(host, r"\."))
    depths = suffix_depths(suffixes)
    cases = [(tail(n).isin(*spared), tail(n)) for n, _, _, spared in depths if spared]
    for n, exact, parents, _ in depths:
        hit = [tail(n).isin(*exact)] if exact else []
        hit += [tail(n - 1).isin(*parents)] if parents else []
        if hit:
            # The look-up comes first: hosts without a rule, nearly all, are not split.
            cases.append(((hit[0] | hit[1] if len(hit) > 1 else hit[0]) & (labels >= n), F.when(labels > n, tail(n + 1))))
    found = tail(2)
    for condition, value in reversed(cases):
        found = F.when(condition, value).otherwise(found)
    return F.when(host.rlike(REGISTRABLE), found)


_BARE = r"^(?:[a-z0-9-]+\.)+[a-z]{2,}$"


def source_host(source: Column) -> Column:
    """Host of a source that is a URL or a bare host name."""
    low = F.lower(source)
    return F.when(low.rlike(r"^[a-z][a-z0-9+.-]*://"), url_host(source)).when(low.rlike(_BARE), low)


def source_domain(source: Column, suffixes: tuple[str, ...]) -> Column:
    """Registered domain of a source that is a host name, with or without a scheme, and nothing more."""
    low = F.lower(source)
    bare = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    return F.when(bare.rlike(_BARE), reg_domain(bare, suffixes))


#: Visible ASCII and blanks but no quote and backslash: what stands in JSON as it is.
PLAIN = r"\A[ !#-\[\]-~]*\z"


def hash_key(**parts: Column) -> Column:
    """Hex SHA-256 of the parts as a JSON object, nulls kept.

    Texts without a character that JSON escapes, and integers, are put together directly, which gives the same object.
    """
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"})
    plain, pieces = F.lit(True), []
    for k, c in parts.items():
        is_text = F.typeof(c) == "string"  # folded, as a type is known before any row is read
        plain = plain & (F.typeof(c).isin("bigint", "int") | (is_text & F.coalesce(c.cast("string").rlike(PLAIN), F.lit(True))))
        value = F.when(is_text, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
        pieces += [F.lit(("," if pieces else "{") + f'"{k}":'), F.coalesce(value, F.lit("null"))]
    return F.sha2(F.when(plain, F.concat(*pieces, F.lit("}"))).otherwise(whole), 256)


def days(n: Column | int) -> Column:
    return F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


def seconds(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))


def whole_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, truncated."""
    return F.timestamp_diff("SECOND", start, end).cast("long")


def divide(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def get_param(params: Column, key: str, kind: str) -> Column:
    """Value of the first parameter with this key, or null."""
    return F.get(params["value"][kind], F.array_position(params["key"], key).cast("int") - 1)


def count_params(params: Column, key: str) -> Column:
    return F.size(F.filter(params, lambda p: p["key"] == key))


def adjacent_pairs(path: Column) -> Column:
    """array<struct<src, dst>> of neighbours."""
    return F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))


def compress_path(path: Column) -> Column:
    """Without elements equal to the one before."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1)))


def omit_direct(path: Column) -> Column:
    """Without Direct, if anything else is there."""
    return F.when(F.exists(path, lambda x: x != "Direct"), F.filter(path, lambda x: x != "Direct")).otherwise(path)


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
