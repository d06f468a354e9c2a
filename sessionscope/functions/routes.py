"""Request paths to route groups, response codes to categories, both to states. Column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionscope.config import STATE_FIELDS

UNKNOWN = "unknown"
STATE_PREFIX = "state-v5:"
# Fixed value: what counts as an identifier in a path.
IDENTIFIER = r"\A(?:\{[^{}]+\}|(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})|[0-9]{6,})\z"
BLANKS = r"\A\s+|\s+\z"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, however often f names it; columns alone are put in at each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def url_path(uri: Column) -> Column:
    """The path of a URI: no scheme, host, query or fragment. With brackets in the host that don't pair up, all but query and fragment."""
    return bound(F.regexp_replace(stripped(uri), r"(?s)[?#].*\z", ""), _path)


def _path(bare: Column) -> Column:
    behind_host = F.regexp_replace(bare, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")
    host = F.regexp_extract(bare, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/]*)", 1)
    odd = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    bracketed = F.contains(bare, F.lit("[")) | F.contains(bare, F.lit("]"))
    return F.when(bracketed & odd, bare).otherwise(behind_host)


def normalize_uri(uri: Column) -> Column:
    """The path with identifiers as ':id' and a leading slash; case, short numbers and double slashes stay; blank is 'unknown'."""

    def of_path(path: Column) -> Column:
        segments = F.transform(F.split(path, "/", -1), lambda s: F.when(s.rlike(IDENTIFIER), ":id").otherwise(s))
        slash = F.when(F.startswith(path, F.lit("/")), "").otherwise("/")  # a path that begins with one has an empty first segment
        return F.when(path.isNull() | (path == ""), UNKNOWN).otherwise(F.concat(slash, F.array_join(segments, "/")))

    return bound(url_path(uri), of_path)


def url_group(normalized: Column) -> Column:
    """The first two named segments (three behind api), lower case, joined by dots."""

    def of_segments(low: Column) -> Column:
        n = F.size(low)
        return (
            F.when(n == 0, "root")
            .when((F.get(low, F.lit(0)) == "api") & (n >= 3), F.array_join(F.slice(low, 1, 3), "."))
            .when(n >= 2, F.array_join(F.slice(low, 1, 2), "."))
            .otherwise(F.concat(F.lit("route."), F.get(low, F.lit(0))))
        )

    def of_path(normalized: Column) -> Column:
        path = F.regexp_replace(normalized, r"(?s)[?#].*\z", "")
        low = F.transform(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ":id")), F.lower)
        return F.when(normalized.isNull() | (stripped(normalized) == "") | (normalized == UNKNOWN), UNKNOWN).otherwise(bound(low, of_segments))

    return bound(normalized, of_path)


def status_class(status: Column) -> Column:
    """Nxx for three digits from 100 to 599, else 'unknown'."""
    in_class = lambda text: F.when(text.rlike(r"\A[1-5][0-9]{2}\z"), F.concat(F.substring(text, 1, 1), F.lit("xx"))).otherwise(UNKNOWN)
    return bound(stripped(status.cast("string")), in_class)


def status_category(status: Column) -> Column:
    def of_text(text: Column) -> Column:
        first = F.substring(text, 1, 1)
        return (
            F.when(~F.coalesce(text.rlike(r"\A[1-5][0-9]{2}\z"), F.lit(False)), UNKNOWN)
            .when(first == "2", "success")
            .when(first == "3", "redirect")
            .when(text.isin("401", "403"), "auth_failure")
            .when(text == "404", "not_found")
            .when(text == "429", "rate_limited")
            .when(first == "4", "client_error")
            .when(first == "5", "server_error")
            .otherwise("informational")
        )

    return bound(stripped(status.cast("string")), of_text)


def describe_state(method: Column, group: Column, category: Column, fields: tuple[str, ...]) -> Column:
    """Compact JSON of the chosen fields, keys in alphabetical order."""
    if not fields or len(set(fields)) != len(fields) or set(fields) - set(STATE_FIELDS):
        raise ValueError(f"fields must be a non-empty unique subset of {STATE_FIELDS}")
    verb = F.upper(stripped(method))
    values = {"method": F.when(verb.isNull() | (verb == ""), UNKNOWN).otherwise(verb), "url_group": group, "status_category": category}
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(fields)]))


def state_id(description: Column) -> Column:
    return F.concat(F.lit(STATE_PREFIX), F.sha2(description, 256))
