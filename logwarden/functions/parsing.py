"""Column expressions for access-log lines: formats, times, status classes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted line formats.
COMBINED = r'^(\S+)\s+-\s+-\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+HTTP/[^"]+"\s+(\d+)\s+(?:\d+|-)\s+"([^"]*)"\s+"([^"]*)"'
CDN = r"^[^|]+\|\d+\|\d+\|\d+\|\d+\|[^|]+\|[^|]*\|[^|]+\|[^|]+\|[^|]+\|[^|]+\|[^|]+$"
ROTATION = r"^\d{4}-\d{2}-\d{2}T.*newsyslog"
CDN_FIELDS = ("cache_status", "status", "ms", "bytes", "zone", "ip", "ref", "url", "edge", "ua", "request_id", "country")
COMBINED_FIELDS = ("ip", "time", "verb", "path", "status", "ref", "ua")
_MARK = "\u0001"
#: What counts as white space around a line.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def combined_parts(line: Column) -> Column:
    """An array of COMBINED_FIELDS in one pass of the pattern; of one element where it does not match."""
    marks = _MARK.join(f"${k}" for k in range(1, len(COMBINED_FIELDS) + 1))
    return F.split(F.regexp_replace(F.translate(line, _MARK, ""), f"(?s){COMBINED}.*$", marks), _MARK)


def is_combined(parts: Column) -> Column:
    return F.size(parts) == len(COMBINED_FIELDS)


def is_cdn(line: Column) -> Column:
    return F.coalesce(line.rlike(CDN), F.lit(False))


def combined_time(text: Column) -> Column:
    """A time such as 25/Sep/2025:19:00:01 +0000; the offset is dropped, bad times are null."""
    return F.try_to_timestamp(F.split(text, r"\s+")[0], F.lit("d/MMM/yyyy:H:m:s"))


def cdn_time(ms: Column) -> Column:
    return F.timestamp_millis(ms.try_cast("long"))


def status_class(status: Column) -> Column:
    out = F.lit("other")
    for k in (5, 4, 3, 2):
        out = F.when(status.between(100 * k, 100 * k + 99), f"{k}xx").otherwise(out)
    return out


def is_error(klass: Column) -> Column:
    return klass.isin("4xx", "5xx")


def optional(text: Column) -> Column:
    """'' and '-' mean that there is none."""
    return F.when(~text.isin("", "-"), text)


def url_path(url: Column) -> Column:
    """The path of a URL without query, fragment and the last segment's parameters; '/' if empty."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*$", "")
    return F.when(url.isNotNull(), F.when(path == "", "/").otherwise(path))


def deepest_depth(path: Column, depths: tuple[int, ...]) -> Column:
    """The largest depth that the path's length reaches; 0 if none."""
    out = F.lit(0)
    for d in sorted(depths):
        out = F.when(F.length(path) >= d, d).otherwise(out)
    return out


def prefix_at(path: Column, depth: int) -> Column:
    """The first characters of a path, null where it is shorter."""
    return F.when(F.length(path) >= depth, F.substring(path, 1, depth))


def prefixes(path: Column, depths: tuple[int, ...]) -> Column:
    """An array of (depth, prefix) of all depths that the path reaches."""
    every = F.array(*[F.struct(F.lit(d).alias("depth"), F.substring(path, 1, d).alias("prefix")) for d in depths])
    return F.filter(every, lambda x: F.length(path) >= x["depth"])
