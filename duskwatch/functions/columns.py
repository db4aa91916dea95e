"""Column functions that the operators share.  All are built from Spark's own."""

from __future__ import annotations

import ipaddress
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\A{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"
FLOAT = r"\A[+-]?([0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))\z"
EPOCH_TICKS = 116444736000000000


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower_text(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def true(c: Column) -> Column:
    """Two-valued logic: null is false."""
    return F.coalesce(c, F.lit(False))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `c`, which is evaluated once a row however often the body names it."""
    return F.transform(F.array(c), body)[0]


def any_of(cs: list[Column]) -> Column:
    return _fold(cs, False)


def all_of(cs: list[Column]) -> Column:
    return _fold(cs, True)


def _fold(cs: list[Column], conj: bool) -> Column:
    """A balanced tree: a thousand terms in a row would be a thousand levels deep."""
    if not cs:
        return F.lit(conj)
    while len(cs) > 1:
        cs = [(cs[i] & cs[i + 1] if conj else cs[i] | cs[i + 1]) if i + 1 < len(cs) else cs[i] for i in range(0, len(cs), 2)]
    return cs[0]


def clean(c: Column) -> Column:
    """Without NULs at the end; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"\x00+\z", ""), F.lit(""))


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(clean(c) for c in cs))


def port_swap(p: Column) -> Column:
    """A port from network byte order; of a wider number its low 16 bits."""
    return F.shiftleft(p.bitwiseAND(255), 8).bitwiseOR(F.shiftright(p, 8).bitwiseAND(255))


def ipv4_text(n: Column) -> Column:
    """Dotted text of a big-endian number."""
    part = lambda k: F.shiftright(n, k).bitwiseAND(255).cast("string")
    return F.when(n.isNotNull(), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def filetime(ft: Column) -> Column:
    """Windows file time as UTC text in whole seconds; anything before 1970 is 1970."""
    seconds = F.floor((F.greatest(ft, F.lit(EPOCH_TICKS)) - F.lit(EPOCH_TICKS)) / F.lit(10_000_000)).cast("long")
    return F.when(ft.isNotNull(), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def basename(path: Column) -> Column:
    bare = F.regexp_replace(path, r'\A"+|"+\z', "")
    return F.nullif(F.regexp_extract(bare, r"([^\\/]*)\z", 1), F.lit(""))


def extension(path: Column) -> Column:
    return F.nullif(F.regexp_extract(basename(path), r"\.([^.]*)\z", 1), F.lit(""))


def is_ipv4(c: Column) -> Column:
    return true(c.rlike(IPV4))


def ipv4_number(c: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    p = F.split(c, r"\.")
    n = sum((p[i].cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), p[0].cast("long") * (1 << 24))
    return F.when(is_ipv4(c), n)


_H = "[0-9A-Fa-f]{1,4}"
SIX = rf"\A(?:{_H}(?::{_H}){{7}}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)\z"


def _groups(c: Column) -> Column:
    """The eight groups of an IPv6 address, lower case and without zeros in front; null for anything else, addresses with a scope included."""
    tail = F.regexp_extract(c, rf":({OCTET}\.{OCTET}\.{OCTET}\.{OCTET})\z", 1)
    low = let(ipv4_number(tail), lambda n: F.concat_ws(":", F.hex(F.shiftright(n, 16)), F.hex(n.bitwiseAND(65535))))
    whole = F.when(tail == "", c).otherwise(F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(tail)), low))

    def groups(v: Column) -> Column:
        part = lambda k: F.filter(F.split(F.coalesce(F.get(F.split(v, "::"), F.lit(k)), F.lit("")), ":"), lambda g: g != "")
        bare = F.transform(part(0), lambda g: F.regexp_replace(F.lower(g), r"\A0+(?=.)", "")), F.transform(part(1), lambda g: F.regexp_replace(F.lower(g), r"\A0+(?=.)", ""))
        filled = let(F.struct(bare[0].alias("a"), bare[1].alias("b")), lambda s: F.when(F.size(s["a"]) + F.size(s["b"]) <= 7, F.concat(s["a"], F.array_repeat(F.lit("0"), 8 - F.size(s["a"]) - F.size(s["b"])), s["b"])))
        return F.when(v.rlike(SIX), F.when(F.contains(v, F.lit("::")), filled).otherwise(bare[0]))

    return let(whole, groups)


def _six_text(g: Column) -> Column:
    """Groups as canonical text: the first longest run of zeros left out, if there are two or more; IPv4 at the end of a mapped address."""
    half = lambda k: F.conv(g[k], 16, 10).cast("long")
    mapped = F.concat(F.lit("::ffff:"), ipv4_text(half(6) * 65536 + half(7)))

    def shorten(t: Column) -> Column:
        out = F.substr(t, F.lit(2), F.length(t) - 2)
        for n in range(2, 9):
            run = ":0" * n + ":"
            at = F.instr(t, run)
            cut = F.concat(F.substr(t, F.lit(2), F.greatest(at - 2, F.lit(0))), F.lit("::"), F.regexp_replace(F.substr(t, at + len(run)), r":\z", ""))
            out = F.when(at > 0, cut).otherwise(out)
        return out

    return F.when(F.array_join(F.slice(g, 1, 6), ":") == "0:0:0:0:0:ffff", mapped).otherwise(let(F.concat(F.lit(":"), F.array_join(g, ":"), F.lit(":")), shorten))


def ipv6_text(c: Column) -> Column:
    """The canonical text of an IPv6 address; null for anything else."""
    return F.when(F.contains(c, F.lit(":")), let(c, lambda v: let(_groups(v), lambda g: F.when(g.isNotNull(), _six_text(g)))))


def ipv6_bits(c: Column) -> Column:
    """An IPv6 address as 128 binary digits; null for anything else.  Its network of n bits is the first n."""
    return F.when(F.contains(c, F.lit(":")), let(c, lambda v: let(_groups(v), lambda g: F.when(g.isNotNull(), F.array_join(F.transform(g, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), "")))))


def ip_text(c: Column, v6: bool = True) -> Column:
    """The canonical text of an address; null for anything else."""
    four = F.when(is_ipv4(c), c)
    return F.coalesce(four, ipv6_text(c)) if v6 else four


def in_network(c: Column, network: str) -> Column:
    """Whether an address lies in a network; false for what is no address."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        n = ipv4_number(c)
        lo = int(net.network_address)
        return true((n >= lo) & (n <= lo + net.num_addresses - 1))

    bits = f"{int(net.network_address):0128b}"[: net.prefixlen]
    return true(F.startswith(ipv6_bits(F.regexp_replace(c, r"%[^%/]+\z", "")), F.lit(bits)))


def address_runs(c: Column) -> Column:
    """Runs of hexadecimal digits, points and colons."""
    return F.regexp_extract_all(c, F.lit(r"([0-9A-Fa-f.:]+)"), 1)


def addresses(c: Column) -> Column:
    """Addresses in a text in their canonical form, sorted, each once."""
    four = F.filter(address_runs(c), lambda t: t.rlike(IPV4))
    maybe = true(c.rlike(":[^:]*:"))
    six = F.when(maybe, F.array_compact(F.transform(F.filter(address_runs(c), lambda t: t.rlike(":[^:]*:")), ipv6_text)))
    return F.array_sort(F.array_distinct(F.concat(four, F.coalesce(six, F.array().cast("array<string>")))))


def whole_number(c: Column, most: int) -> Column:
    """An unsigned decimal number, blanks around it allowed; null beyond `most`."""
    digits = F.regexp_extract(F.trim(c), r"\A\+?([0-9]{1,20})\z", 1)
    n = F.nullif(digits, F.lit("")).cast("decimal(20,0)")
    return F.when(n <= F.lit(str(most)).cast("decimal(20,0)"), n)


def to_float(c: Column) -> Column:
    """A floating-point number in plain notation; null for anything else, NaN included."""
    return F.when(c.rlike(FLOAT), c.try_cast("double"))


def truth(c: Column) -> Column:
    v = ascii_lower(F.trim(c))
    return F.when(v.isin("signed", "true", "valid", "yes"), F.lit(True)).when(v.isin("unsigned", "false", "invalid", "no"), F.lit(False))


def parse_pid(c: Column) -> Column:
    """A process id in decimal or 0x hexadecimal; null beyond 32 bits."""
    v = F.trim(c)
    hexa = F.nullif(F.regexp_extract(v, r"\A0[xX]0*([0-9A-Fa-f]{1,8})\z", 1), F.lit(""))
    return F.coalesce(F.conv(hexa, 16, 10).cast("long"), whole_number(c, (1 << 32) - 1).cast("long"))


def is_sid(c: Column) -> Column:
    return F.startswith(c, F.lit("S-1-"))


def user_parts(c: Column) -> dict[str, Column]:
    """name, id and domain of an account: a SID is an id; what stands before the first backslash is a domain."""
    v = F.nullif(c, F.lit(""))
    cut = F.instr(v, "\\")
    sid = is_sid(v)
    return {
        "name": F.when(sid, F.lit(None)).when(cut > 0, F.substr(v, cut + 1)).otherwise(v),
        "id": F.when(sid, v),
        "domain": F.when(~sid & (cut > 0), F.substr(v, F.lit(1), cut - 1)),
    }


def registry_parts(path: Column, event_type: Column) -> dict[str, Column]:
    """hive, key and value of a registry path; a value only for event types that speak of values."""
    p = F.split(path, r"\\")
    n = F.size(p)
    value = true(F.contains(ascii_lower(event_type), F.lit("value"))) & (n > 1)
    stop = F.when(value, n - 2).otherwise(n - 1)
    return {
        "hive": p[0],
        "key": F.when(path.isNotNull() & (stop > 0), F.nullif(F.array_join(F.slice(p, F.lit(2), F.greatest(stop, F.lit(1))), "\\"), F.lit(""))),
        "value": F.when(value, F.element_at(p, -1)),
    }
