"""Scalar functions over paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_parts(path: Column) -> Column:
    """POSIX parts: a leading "/" is a part, empty parts and "." vanish, a backslash separates nothing."""
    names = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), names)).otherwise(names)


def path_depth(path: Column) -> Column:
    return F.size(path_parts(path))


def chain_parts(chain: Column) -> Column:
    """Parts of a backslash chain."""
    return F.filter(F.split(chain, r"\\"), lambda x: x != "")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading parts that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def tree_distance(a: Column, b: Column) -> Column:
    """Steps from one path to the other through their deepest common parent."""
    p, q = path_parts(a), path_parts(b)
    return F.size(p) + F.size(q) - 2 * common_prefix(p, q)


def path_edges(path: Column) -> Column:
    """An array of (parent, child) of consecutive parts."""
    p = path_parts(path)
    pairs = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("parent"), y.alias("child")))
    return F.when(F.size(p) > 1, pairs).otherwise(F.array().cast("array<struct<parent:string,child:string>>"))


def md5_mod(text: Column, modulus: int = 10**8) -> Column:
    """The md5 digest as a number, modulo: Horner over hex chunks, within 64 bits."""
    chunks = F.sequence(F.lit(0), F.lit(7))
    digest = F.md5(text)
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda s, k: (s * 65536 + F.conv(F.substring(digest, k * 4 + 1, F.lit(4)), 16, 10).cast("long")) % modulus)


def bytes_mod(text: Column, modulus: int = 10**8) -> Column:
    """The text's bytes as a little-endian number, modulo."""
    pairs = F.reverse(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)")))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, h: (s * 256 + F.conv(h, 16, 10).cast("long")) % modulus)


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octets = F.split(ip, r"\.")
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long")))


def is_private_ip(ip: Column) -> Column:
    """Whether an IPv4 address is in one of the three private ranges; false for IPv6, null for other text."""
    n = ipv4_number(ip)
    inside = n.between(10 << 24, (11 << 24) - 1) | n.between((172 << 24) + (16 << 16), (172 << 24) + (32 << 16) - 1) | n.between((192 << 24) + (168 << 16), (192 << 24) + (169 << 16) - 1)
    return F.when(ip.contains(":"), F.lit(False)).otherwise(inside)


def is_attack_label(label: Column, benign: tuple[str, ...] = ("nonvpn", "non-tor")) -> Column:
    """0 for the benign traffic names in any case, else 1."""
    return F.when(F.lower(label).isin(*benign), 0).otherwise(1)
