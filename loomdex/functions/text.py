"""Query terms, URIs and normal forms of names and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import casefold

# Words that carry no meaning for lexical search.
STOP_WORDS = ("a", "az", "egy", "és", "vagy", "hogy", "hogyan", "hol", "mi", "mikor", "milyen", "lehet", "kell", "van", "vannak", "be", "ki", "fel", "le", "meg", "the", "and", "or", "how")
# Patterns of tokens and identifiers.
TERM = "[a-záéíóöőúüű0-9]+"
IPV4 = r"(?:[0-9]{1,3}[.]){3}[0-9]{1,3}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"
WHOLE_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
WHOLE_FQDN = r"^(?=.{4,253}\.?$)(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}\.?$"
LABELLED = r"(?i)\b(serial(?:\s+number)?|s/n|system\s+(?:id|identifier)|asset\s+id)\s*[:#=]\s*([A-Z0-9][A-Z0-9._:/-]{2,127})"
MAC = r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"


def tokens(text: Column) -> Column:
    """All folded tokens of a text, in order."""
    return F.regexp_extract_all(casefold(text), F.lit(TERM), 0)


def query_terms(query: Column) -> Column:
    """Distinct tokens of more than one character that aren't stop words, in first-seen order."""
    return F.array_distinct(F.filter(tokens(query), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def terms_of(query: str) -> list[str]:
    """A single query's terms, on the driver."""
    return [t for t in dict.fromkeys(_found(query)) if len(t) > 1 and t not in STOP_WORDS]


def groups_of(query: str) -> list[list[str]]:
    """What a lexical query asks for, as a disjunction of groups: any of its terms, or, where it has none,
    all of its tokens; ``or`` between tokens separates groups there."""
    words = terms_of(query)
    if words:
        return [[t] for t in words]
    groups: list[list[str]] = [[]]
    found = _found(query)
    for i, t in enumerate(found):
        if t == "or" and groups[-1] and i + 1 < len(found):
            groups.append([])
        elif t not in groups[-1]:
            groups[-1].append(t)
    return [g for g in groups if g]


def _found(query: str) -> list[str]:
    return re.findall(TERM, query.lower().replace("ß", "ss"))


def provenance_uri(prefix: Column, path: Column, start: Column, end: Column) -> Column:
    """``prefix/quoted path#chars=start,end``; slashes stay, spaces are %20."""
    quoted = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), quoted, F.lit("#chars="), start.cast("string"), F.lit(","), end.cast("string"))


def _each(function, column: Column) -> Column:
    """A string function of one value, in Arrow batches; null stays null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(x):
        return x.map(lambda v: None if v is None else function(v))

    return run(column)


def _nfkc(v: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", v)


def _name(v: str) -> str:
    return " ".join(_nfkc(v).casefold().split())


def _address(v: str) -> str | None:
    from ipaddress import ip_address

    try:
        return ip_address(v).compressed
    except ValueError:
        return None


def _beyond(function, column: Column, easy: Column, own: Column) -> Column:
    """``own`` where built-ins will do, the function elsewhere; it is handed nulls for the rest."""
    return F.when(easy, own).otherwise(_each(function, F.when(~easy, column)))


def _ascii(column: Column) -> Column:
    return F.length(column) == F.octet_length(column)


def nfkc(column: Column) -> Column:
    """Unicode compatibility composition, which changes no ASCII; there is no built-in."""
    return _beyond(_nfkc, column, _ascii(column), column)


def normal_name(name: Column) -> Column:
    """Compatibility form, case folded, trimmed, inner white space as one space."""
    own = F.trim(F.regexp_replace(F.lower(name), r"[\s\x1c-\x1f]+", " "))
    return _beyond(_name, name, _ascii(name), own)


def compressed_address(value: Column) -> Column:
    """The short spelling of an IPv4 or IPv6 address; null where it isn't one."""
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return _beyond(_address, value, ~F.contains(value, F.lit(":")), F.when(value.rlike(rf"\A{byte}([.]{byte}){{3}}\z"), value))


def is_loopback(host: Column) -> Column:
    """Whether a host is this machine: ``localhost``, ``::1`` or 127.0.0.0/8."""
    return (F.lower(host) == "localhost") | (host == "::1") | host.rlike(r"^127([.][0-9]{1,3}){3}$")


def normal_identifier(kind: Column, value: Column) -> Column:
    """Canonical spelling of an identifier; null for an unknown kind or an address that isn't one."""
    v = F.trim(nfkc(value))
    digits = F.upper(F.regexp_replace(v, "[:-]", ""))
    at = F.length(v) - F.length(F.substring_index(v, "@", -1))
    return (
        F.when(kind == "ip_address", compressed_address(v))
        .when(kind == "mac_address", F.concat_ws(":", *[F.substring(digits, 2 * i + 1, 2) for i in range(6)]))
        .when(kind == "fqdn", F.lower(F.rtrim(v, F.lit("."))))
        .when(kind == "email_address", F.concat(casefold(F.substr(v, F.lit(1), at)), F.lower(F.substring_index(v, "@", -1))))
        .when(kind.isin("serial_number", "system_id", "asset_id"), F.upper(v))
    )


def strong_identifiers(name: Column, quote: Column) -> Column:
    """Identifiers (kind, value), sorted, that a surface name is as a whole: an address, or a labelled number
    that the quote gives beside its label. A name that only contains one has none."""
    whole = F.trim(nfkc(name))
    kinds = [("ip_address", compressed_address(whole).isNotNull()), ("mac_address", whole.rlike(f"^{MAC}$")), ("email_address", whole.rlike(WHOLE_EMAIL)), ("fqdn", whole.rlike(WHOLE_FQDN))]
    own = [F.when(test, F.struct(F.lit(k).alias("kind"), normal_identifier(F.lit(k), whole).alias("value"))) for k, test in kinds]
    labels, values = (F.regexp_extract_all(quote, F.lit(LABELLED), i) for i in (1, 2))
    own_name = F.array_repeat(F.lower(whole), F.size(values))  # a lambda can't hold a Python function's value
    near = F.filter(F.arrays_zip(labels.alias("label"), values.alias("value"), own_name.alias("name")), lambda x: F.lower(x["value"]) == x["name"])
    kind = lambda x: F.when(F.lower(x["label"]).rlike("^s(erial|/n)"), "serial_number").when(F.lower(x["label"]).startswith("system"), "system_id").otherwise("asset_id")
    labelled = F.transform(near, lambda x: F.struct(kind(x).alias("kind"), F.upper(x["value"]).alias("value")))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*own)), F.coalesce(labelled, F.array().cast("array<struct<kind: string, value: string>>")))))


def slug(model: Column, dimension: Column) -> Column:
    """Name of a vector collection: folded letters and digits, 40 at most, and the dimension."""
    clean = F.regexp_replace(F.lower(model), r"[^\p{L}\p{N}]+", "_")
    return F.concat(F.lit("chunks_"), F.left(F.trim(clean, F.lit("_")), F.lit(40)), F.lit("_"), dimension.cast("string"))
