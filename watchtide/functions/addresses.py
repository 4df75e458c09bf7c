"""IP addresses as bits, inside the JVM: IPv4 as a number, IPv6 as two longs."""

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
_V6 = rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?\z"
_NETWORK = r"^([^/]*)(?:/([0-9]{1,3}))?\z"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def v4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    return F.when(ip.rlike(_V4), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long")))


def _groups(half: Column) -> Column:
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))


def _long(groups: Column) -> Column:
    return F.aggregate(groups, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 16).bitwiseOR(F.conv(x, 16, 10).cast("long")))


def _v6(ip: Column) -> Column:
    """hi, lo of an IPv6 address in any of its spellings (one ::, an IPv4 tail, a scope after %); null if it is none."""

    def bits(text: Column) -> Column:
        halves = F.split(text, "::", -1)
        left, right = _groups(halves[0]), _groups(F.coalesce(F.get(halves, 1), F.lit("")))
        absent = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), absent), right)
        fits = F.when(F.size(halves) == 1, absent == 0).otherwise(absent > 0)
        return F.when(text.rlike(_V6) & fits, F.struct(_long(F.slice(whole, 1, 4)).alias("hi"), _long(F.slice(whole, 5, 4)).alias("lo")))

    def spelled(bare: Column) -> Column:
        def without_tail(v4: Column) -> Column:
            tail = F.concat(F.hex(F.shiftright(v4, 16)), F.lit(":"), F.hex(v4.bitwiseAND(F.lit(65535).cast("long"))))
            return F.when(v4.isNull(), bare).otherwise(F.concat(F.regexp_replace(bare, r"[^:]+\z", ""), tail))

        return _let(_let(v4_number(F.regexp_extract(bare, r"([^:]*)\z", 1)), without_tail), bits)

    return _let(F.regexp_extract(ip, r"^([^%]*)(?:%[^%]+)?\z", 1), spelled)


def address_bits(ip: Column) -> Column:
    """version (4 or 6), hi, lo: an address as 128 bits in two longs, an IPv4 one in the first 32; null if it is none."""
    v4 = _let(v4_number(ip), lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("version"), F.shiftleft(n, 32).alias("hi"), F.lit(0).cast("long").alias("lo"))))
    v6 = _let(_v6(ip), lambda b: F.when(b.isNotNull(), F.struct(F.lit(6).alias("version"), b["hi"].alias("hi"), b["lo"].alias("lo"))))
    return F.when(ip.contains(":"), v6).otherwise(v4)


def first_bits(bits: Column, n: Column) -> Column:
    """The first n bits of a long; the others 0."""
    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - n).cast("int"))
    return F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, bits).otherwise(bits.bitwiseAND(mask))


def network_bits(cidr: Column) -> Column:
    """version, length, hi, lo of a network as address/length (no length: the address alone). Null stays null; what is no network, or has bits after its length, fails the query."""
    length = F.regexp_extract(cidr, _NETWORK, 2)

    def whole(bits: Column) -> Column:
        full = F.when(bits["version"] == 4, 32).otherwise(128)
        n = F.when(length == "", full).otherwise(length.try_cast("int"))
        plain = (n <= full) & (first_bits(bits["hi"], n) == bits["hi"]) & (first_bits(bits["lo"], n - 64) == bits["lo"])
        found = F.struct(bits["version"].alias("version"), n.alias("length"), bits["hi"].alias("hi"), bits["lo"].alias("lo"))
        return F.when(bits.isNotNull() & plain, found).otherwise(F.raise_error(F.concat(F.lit("no network: "), cidr)).cast(NETWORK))

    return F.when(cidr.isNotNull(), _let(address_bits(F.regexp_extract(cidr, _NETWORK, 1)), whole))


NETWORK = "struct<version: int, length: int, hi: bigint, lo: bigint>"


def _signed(n: int) -> Column:
    return F.lit(n - (n >> 63 << 64)).cast("long")


def in_network(ip: Column, cidr: str, strict: bool = False) -> Column:
    """Whether the address lies in the network; null if it is no address. strict: host bits of cidr are an error."""
    network = ipaddress.ip_network(cidr, strict=strict)
    first = int(network.network_address) << (32 if network.version == 4 else 0)
    hi, lo = (first << 64, 0) if network.version == 4 else (first, first)
    hi, lo, n = _signed(hi >> 64), _signed(lo & (1 << 64) - 1), F.lit(network.prefixlen)

    def inside(a: Column) -> Column:
        return F.when(a.isNotNull(), (a["version"] == network.version) & (first_bits(a["hi"], n) == hi) & (first_bits(a["lo"], n - 64) == lo))

    return _let(address_bits(ip), inside)


def network_size(cidr: str) -> int:
    return ipaddress.ip_network(cidr, strict=False).num_addresses
