"""IP addresses: canonical form, 128-bit value, network; all by expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return sum((parts[k].cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))


def ipv4_hex(ip: Column) -> Column:
    return F.lpad(F.lower(F.hex(ipv4_number(ip))), 32, "0")


def ipv4_network(ip: Column, length: int = 24) -> Column:
    """The network of an IPv4 address, host bits cleared."""
    if length % 8 == 0 and 0 < length < 32:
        return F.concat(F.substring_index(ip, ".", length // 8), F.lit(".0" * (4 - length // 8) + f"/{length}"))
    mask = (0xFFFFFFFF << (32 - length)) & 0xFFFFFFFF
    n = ipv4_number(ip).bitwiseAND(F.lit(mask))
    octet = lambda k: F.shiftright(n, 8 * (3 - k)).bitwiseAND(F.lit(255)).cast("string")
    return F.concat(F.concat_ws(".", *[octet(k) for k in range(4)]), F.lit(f"/{length}"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a name for a value that it uses several times, so that it is worked out once."""
    return F.transform(F.array(value), body)[0]


def _ipv6_hex(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in any notation; null if it is none."""
    dotted = F.regexp_extract(text, rf":({IPV4[1:-1]})$", 1)
    as_hex = lambda d: F.lower(F.lpad(F.hex(ipv4_number(d)), 8, "0"))
    plain = _let(dotted, lambda d: F.when(d == "", text).otherwise(F.concat(F.left(text, F.length(text) - F.length(d)), F.left(as_hex(d), F.lit(4)), F.lit(":"), F.right(as_hex(d), F.lit(4)))))
    hextets = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def filled(sides: Column) -> Column:
        left = hextets(sides[0])
        right = F.when(F.size(sides) == 2, hextets(F.try_element_at(sides, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        gap = 8 - F.size(left) - F.size(right)
        fits = F.when(F.size(sides) == 1, gap == 0).otherwise((F.size(sides) == 2) & (gap >= 1))
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
        return F.when(fits & F.forall(every, lambda h: h.rlike("^[0-9A-Fa-f]{1,4}$")), F.lower(F.array_join(F.transform(every, lambda h: F.lpad(h, 4, "0")), "")))

    return _let(F.split(plain, "::"), filled)


def _ipv6_text(digits: Column) -> Column:
    """The canonical notation of 32 hexadecimal digits: the longest run of two or more zero groups is left out."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.coalesce(F.nullif(F.ltrim(F.substr(digits, k * 4 + 1, F.lit(4)), F.lit("0")), F.lit("")), F.lit("0")))

    def shortened(shown: Column) -> Column:
        out = F.substring(shown, 2, 40)
        out = F.left(out, F.length(out) - 1)
        for n in range(2, 9):
            zeros = ":0" * n + ":"
            at = F.instr(shown, zeros)
            head = F.substr(shown, F.lit(2), at - 2)
            tail = F.substr(shown, at + len(zeros))
            cut = F.concat(F.when(at > 1, head).otherwise(""), F.lit("::"), F.when(F.length(tail) > 0, F.left(tail, F.length(tail) - 1)).otherwise(""))
            out = F.when(at > 0, cut).otherwise(out)
        return out

    byte = lambda k: F.conv(F.substring(digits, 25 + 2 * k, 2), 16, 10)
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[byte(k) for k in range(4)]))
    usual = _let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), shortened)
    return F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), mapped).otherwise(usual)


def _masked(digits: Column, length: int) -> Column:
    """Hexadecimal digits with all but the first ``length`` bits cleared."""
    whole, bits = divmod(length, 4)
    kept = F.substring(digits, 1, whole)
    if bits:
        part = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(15 & (15 << (4 - bits))))
        kept = F.concat(kept, F.lower(F.hex(part)))
    return F.rpad(kept, 32, "0")


def _ipv6_value(ip: Column) -> Column:
    """_ipv6_hex() of an address that may name a zone after a percent sign."""
    bare = F.when(F.length(ip) - F.length(F.replace(ip, F.lit("%"))) <= 1, F.substring_index(ip, "%", 1))
    return F.when(~F.endswith(ip, F.lit("%")), _ipv6_hex(bare))


def ip_facts(ip: Column) -> Column:
    """canonical and ip_hex of an address of either kind; an invalid one stays as it is and has a null value."""
    zone = F.when(F.contains(ip, F.lit("%")), F.concat(F.lit("%"), F.substring_index(ip, "%", -1))).otherwise("")
    v6 = lambda digits: F.struct(F.when(digits.isNull(), ip).otherwise(F.concat(_ipv6_text(digits), zone)).alias("canonical"), digits.alias("ip_hex"))
    v4 = F.struct(ip.alias("canonical"), F.when(is_ipv4(ip), ipv4_hex(ip)).alias("ip_hex"))
    return F.when(F.contains(ip, F.lit(":")), _let(_ipv6_value(ip), v6)).otherwise(v4)


def _plain_ipv6(ip: Column, groups: int) -> Column:
    """Whether an address begins with so many groups as they stand in canonical notation, none of them zero, and has :: behind them.

    Fewer than eight colons, so that :: stands for a group at least.
    """
    return ip.rlike(rf"^(?!(?:[^:]*:){{8}})(?:[1-9a-f][0-9a-f]{{0,3}}:){{{groups}}}(?:[0-9A-Fa-f]{{1,4}}:)*:(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}})*)?\z")


def network_of(ip: Column, v4_length: int = 24, v6_length: int = 48) -> Column:
    """The network of an address of either kind, host bits cleared; an invalid address is its own.

    IPv6 addresses in the usual notation are cut as texts, others are written out first.
    """
    v6 = lambda digits: F.when(digits.isNull(), ip).otherwise(F.concat(_ipv6_text(_masked(digits, v6_length)), F.lit(f"/{v6_length}")))
    v4 = F.when(is_ipv4(ip), ipv4_network(ip, v4_length)).otherwise(ip)
    out, groups = _let(_ipv6_value(ip), v6), v6_length // 16
    if v6_length % 16 == 0 and 1 <= groups <= 6:
        out = F.when(_plain_ipv6(ip, groups), F.concat(F.substring_index(ip, ":", groups), F.lit(f"::/{v6_length}"))).otherwise(out)
    return F.when(F.contains(ip, F.lit(":")), out).otherwise(v4)


def ip_dimension(ips: DataFrame, column: str = "ip", v4_length: int = 24, v6_length: int = 48) -> DataFrame:
    """(raw, canonical, ip_hex, cidr, is_v6) of the distinct addresses of a column.

    An invalid address stays as it is, is its own network and has a null value. Nulls are left out.
    """
    raw = ips.select(F.col(column).alias("raw")).filter(F.col("raw").isNotNull()).distinct()
    facts = raw.withColumn("__f", ip_facts(F.col("raw"))).withColumn("cidr", network_of(F.col("raw"), v4_length, v6_length))
    return facts.select("raw", "__f.canonical", "__f.ip_hex", "cidr", (F.contains("raw", F.lit(":")) & F.col("__f.ip_hex").isNotNull()).alias("is_v6"))


def network_base(cidrs: DataFrame, column: str = "cidr") -> DataFrame:
    """(raw, canonical) of the distinct networks of a column, host bits cleared; invalid ones stay as they are."""

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            try:
                return str(ipaddress.ip_network(text, strict=False))
            except ValueError:
                return text

        return values.map(one)

    raw = cidrs.select(F.col(column).alias("raw")).filter(F.col("raw").isNotNull()).distinct()
    return raw.withColumn("canonical", canonical("raw"))
