"""IPv4 addresses as integers, CIDR blocks as ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def ipv4(c: Column) -> Column:
    """Dotted text to a bigint, null when it is not an IPv4 address."""
    value = F.aggregate(F.split(c, r"\."), F.lit(0).cast("bigint"), lambda v, part: v * 256 + part.try_cast("bigint"))
    return F.when(c.rlike(_IPV4), value)


def cidr_bounds(block: str) -> tuple[int, int]:
    """Lowest and highest address of a constant block; a bare address is /32."""
    addr, _, prefix = block.partition("/")
    bits = int(prefix or 32)
    octets = [int(o) for o in addr.split(".")]
    if len(octets) != 4 or not all(0 <= o <= 255 for o in octets) or not 0 <= bits <= 32:
        raise ValueError(f"not an IPv4 block: {block}")
    value = int.from_bytes(bytes(octets), "big")
    span = 1 << (32 - bits)
    low = value // span * span
    return low, low + span - 1


def in_blocks(ip: Column, blocks: list[str]) -> Column:
    """Is the integer address inside any of the constant blocks (null -> false)."""
    hit = F.lit(False)
    for low, high in map(cidr_bounds, blocks):
        hit = hit | ip.between(low, high)
    return F.coalesce(hit, F.lit(False))


def block_low_high(c: Column) -> tuple[Column, Column]:
    """Bounds of a block held in a column, with the prefix length optional."""
    low, bits = block_key(c)
    span = F.call_function("shiftleft", F.lit(1).cast("bigint"), (32 - bits).cast("int"))
    return low * span, low * span + span - 1


def block_key(c: Column) -> tuple[Column, Column]:
    """(address shifted right by the host bits, prefix length) of a block."""
    bits = F.coalesce(F.get(F.split(c, "/"), F.lit(1)).try_cast("int"), F.lit(32))
    addr = ipv4(F.get(F.split(c, "/"), F.lit(0)))
    ok = bits.between(0, 32)
    return F.when(ok, F.call_function("shiftright", addr, (32 - bits).cast("int"))), F.when(ok, bits)


def _constant(block: str) -> tuple[int, int]:
    """(lowest address, prefix length) of a constant block."""
    low, high = cidr_bounds(block)
    return low, 33 - (high - low + 1).bit_length()


def is_subset(c: Column, block: str) -> Column:
    """Is the address or block in ``c`` wholly inside the constant block; null if it is neither."""
    low, bits = _constant(block)
    parts = F.split(c, "/")
    own = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(32))
    inside = F.call_function("shiftright", ipv4(F.get(parts, F.lit(0))), F.lit(32 - bits)) == F.lit(low >> (32 - bits))
    return F.when(own.between(0, 32), inside & (own >= bits))


def is_superset(c: Column, block: str) -> Column:
    """Does the address or block in ``c`` wholly contain the constant block; null if it is neither."""
    low, bits = _constant(block)
    key, own = block_key(c)
    same = key == F.call_function("shiftright", F.lit(low), (32 - own).cast("int"))
    return F.when(same.isNotNull(), same & (own <= bits))
