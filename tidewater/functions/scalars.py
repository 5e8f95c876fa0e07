"""Column -> Column rules in built-in expressions: counters, schedules, verdicts, keys, links, formats, addresses, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1
DAY = 86_400
# Fixed values of the schedules.
BACKOFF_FIRST, BACKOFF_MOST, GIVE_UP_AT = 300, 7 * DAY, 2
COOLDOWN_GROWTH, COOLDOWN_MOST, STRONG_SIGHTINGS, STRONG_SHARE = 4, 90 * DAY, 3, 4
POPULARITY = 0.15


# --- counters and comparisons

def saturating_add(a: Column, b: Column) -> Column:
    """Sum of non-negative longs, the largest long on overflow."""
    return F.coalesce(F.try_add(a.cast("long"), b.cast("long")), F.when(a.isNotNull() & b.isNotNull(), F.lit(MAX_LONG)))


def bucket_changed(old: Column, new: Column) -> Column:
    """Do two positive counts have different highest bits?"""
    return old.bitwiseXOR(new) > old.bitwiseAND(new)


def content_changed(old: list[Column], new: list[Column]) -> Column:
    """Null-safe comparison of tuples."""
    return ~F.struct(*old).eqNullSafe(F.struct(*new))


# --- schedules

def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(BACKOFF_FIRST) * F.pow(F.lit(2.0), F.least(attempts, F.lit(30))), F.lit(BACKOFF_MOST)).cast("long")


def gives_up(attempts: Column) -> Column:
    return attempts >= GIVE_UP_AT


def cooldown_seconds(removals: Column, base_days: int) -> Column:
    """None without a base; else base, four times that, then 90 days; never more than 90 days."""
    base = base_days * DAY
    return (
        F.when(F.lit(base) <= 0, 0)
        .when(removals <= 0, 0)
        .when(removals == 1, min(base, COOLDOWN_MOST))
        .when(removals == 2, min(COOLDOWN_GROWTH * base, COOLDOWN_MOST))
        .otherwise(COOLDOWN_MOST)
        .cast("long")
    )


def cooldown_left(removals: Column, sightings: Column, strong: Column, removed_at: Column, as_of: Column, base_days: int) -> Column:
    """Seconds still to wait: a quarter on strong evidence, less what has passed; all of it if removed in the future."""
    whole = cooldown_seconds(removals, base_days)
    wait = F.when(strong | (sightings >= STRONG_SIGHTINGS), F.floor(whole / STRONG_SHARE)).otherwise(whole)
    passed = F.greatest(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(removed_at.cast("timestamp")), F.lit(0))
    return F.greatest(wait - passed, F.lit(0)).cast("long")


def ladder_seconds(strikes: Column, base: int, most: int) -> Column:
    """base, 2 base, 4 base, ... up to ``most``; 0 before the first strike."""
    return F.when(strikes <= 0, 0).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(strikes, F.lit(40)) - 1), F.lit(most))).cast("long")


def next_sample_seconds(outcome: Column, interval: Column, strikes: Column, floor: int = 300, ceiling: int = 21_600) -> Column:
    """When to ask again: the answer's interval within bounds, the ceiling for unsupported or wrong ids, a ladder for timeouts."""
    return (
        F.when(outcome == "answer", F.least(F.greatest(F.coalesce(interval, F.lit(ceiling)), F.lit(floor)), F.lit(ceiling)))
        .when(outcome == "timeout", ladder_seconds(strikes, floor, ceiling))
        .otherwise(ceiling)
        .cast("long")
    )


# --- verdicts

def popularity(seen: Column) -> Column:
    return 1 + F.lit(POPULARITY) * F.log10(1 + seen)


def seeder_boost(estimate: Column) -> Column:
    """1 where nothing is known."""
    return F.coalesce(1 + F.lit(POPULARITY) * F.log10(1 + estimate), F.lit(1.0))


def effort(estimate: Column) -> Column:
    """struct<dials, lookups> by estimate: unknown and dead get little, five and more get two lookups."""
    dials = F.when(F.coalesce(estimate, F.lit(0)) <= 0, 3).otherwise(8)
    return F.struct(dials.alias("dials"), F.when(estimate >= 5, 2).otherwise(1).alias("lookups"))


def estimate_bucket(estimate: Column) -> Column:
    return F.when(estimate.isNull(), "null").when(estimate <= 0, "dead").when(estimate < 5, "low").otherwise("high")


def verdict(estimate: Column, threshold: int, both_families: Column) -> Column:
    """unknown without an estimate; live over the threshold; dead only if both address families were tried."""
    return F.when(estimate.isNull(), "unknown").when(estimate > threshold, "live").when(both_families, "dead").otherwise("unknown")


def fresh(estimate: Column, scraped_at: Column, as_of: Column, seconds: int) -> Column:
    """The estimate if it is at most so old."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(scraped_at.cast("timestamp"))
    return F.when(estimate.isNotNull() & (age <= seconds * 1_000_000), estimate)


# --- keys and links

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def parse_key(text: Column) -> Column:
    """struct<kind, key>: 40 hex or 32 base32 characters are v1, 64 hex are v2, in any case; null for anything else."""
    t = F.upper(F.trim(text))
    places = F.transform(F.split(F.when(t.rlike("^[A-Z2-7]{32}$"), t), ""), lambda c: F.lpad(F.conv((F.instr(F.lit(_BASE32), c) - 1).cast("string"), 10, 2), 5, "0"))
    bits = F.array_join(places, "")
    quads = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lpad(F.conv(F.substr(bits, i * 16 + 1, F.lit(16)), 2, 16), 4, "0"))
    v1 = F.when(t.rlike("^[0-9A-F]{40}$"), F.unhex(t)).when(t.rlike("^[A-Z2-7]{32}$"), F.unhex(F.array_join(quads, "")))
    v2 = F.when(t.rlike("^[0-9A-F]{64}$"), F.unhex(t))
    return F.when(v1.isNotNull(), F.struct(F.lit("v1").alias("kind"), v1.alias("key"))).when(v2.isNotNull(), F.struct(F.lit("v2").alias("kind"), v2.alias("key")))


def encode_query(text: Column) -> Column:
    """RFC 3986 percent-encoding."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def magnet(v1: Column, v2: Column, name: Column) -> Column:
    """Null without a hash; ``name`` is already fit to display."""
    parts = F.array_compact(
        F.array(
            F.when(v1.isNotNull(), F.concat(F.lit("xt=urn:btih:"), F.lower(F.hex(v1)))),
            F.when(v2.isNotNull(), F.concat(F.lit("xt=urn:btmh:1220"), F.lower(F.hex(v2)))),
            F.when(F.left(name, F.lit(200)) != "", F.concat(F.lit("dn="), encode_query(F.rtrim(F.left(name, F.lit(200)))))),
        )
    )
    return F.when(v1.isNotNull() | v2.isNotNull(), F.concat(F.lit("magnet:?"), F.array_join(parts, "&")))


def matches_hash(data: Column, key: Column) -> Column:
    """v1 if the SHA-1 of the bytes is the 20-byte key, v2 if the SHA-256's first 20 bytes are, else null."""
    return F.when(F.unhex(F.sha1(data)) == key, "v1").when(F.substring(F.unhex(F.sha2(data, 256)), 1, 20) == key, "v2")


def alias_of(v2: Column) -> Column:
    """The 20-byte name of a 32-byte hash."""
    return F.substring(v2, 1, 20)


def partition_word(key: Column) -> Column:
    """The key's first four bytes as a number."""
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long")


# --- formats

_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def human_size(size: Column) -> Column:
    """Binary units with one decimal, half up in whole tenths; 1024.0 of a unit is 1.0 of the next."""
    n = size.cast("decimal(38,0)")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i in range(1, len(_UNITS)):
        unit = 1 << (10 * i)
        tenths = F.floor((n * 10 + F.lit(unit // 2).cast("decimal(38,0)")) / F.lit(unit).cast("decimal(38,0)")).cast("decimal(38,0)")
        before = F.floor((n * 10 + F.lit(unit // 2048).cast("decimal(38,0)")) / F.lit(unit >> 10).cast("decimal(38,0)")) if i > 1 else n * 10
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {_UNITS[i]}"))
        out = F.when(before >= 10240, text).otherwise(out)
    return out


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(grouped(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def safe_json(json: Column) -> Column:
    """JSON that may stand in HTML: < > & ' and the two line separators as escapes."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit(f"\\u{ord(ch):04x}")), "<>&'\u2028\u2029", json)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- addresses

#: IPv4 ranges that are not routed globally, as (network, prefix length).
_RESERVED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


# Global IPv6 prefixes that are for documentation and the like, in hexadecimal.
_RESERVED_V6 = ("20010DB8", "2001001", "3FFF0")


def ipv4_number(text: Column) -> Column:
    """The address as a number; null if it is not four bytes in decimal."""
    ok = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")
    parts = F.split(F.when(ok, text), r"\.")
    return sum((parts[i].cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), parts[0].cast("long") * (1 << 24))


def ipv4_global(number: Column) -> Column:
    def value(dotted: str) -> int:
        return reduce(lambda n, part: n * 256 + int(part), dotted.split("."), 0)

    inside = [F.shiftright(number, 32 - bits) == value(net) >> (32 - bits) for net, bits in _RESERVED_V4]
    return ~reduce(lambda a, b: a | b, inside)


def ipv4_dialable(number: Column, port: Column) -> Column:
    return number.isNotNull() & (port > 0) & (port < 65536) & ipv4_global(number)


def source_network(number: Column) -> Column:
    """The /24 of an IPv4 address, tagged so that it is no IPv6 /48."""
    return F.shiftright(number, 8).bitwiseOR(F.lit(1 << 48))


# --- addresses of 4 or 16 bytes, as expressions

def _hexes(hex_: Column, at: int, n: int) -> Column:
    """n hexadecimal digits from the place ``at`` (from 0) as a number."""
    return F.conv(F.substring(hex_, at + 1, n), 16, 10).cast("long")


def inner_ipv4(ip: Column) -> Column:
    """The number of an IPv4 address, also where 16 bytes hold it as a mapped or compatible one; else null."""
    h = F.hex(ip)
    last = _hexes(h, 24, 8)
    held = h.startswith("0" * 20 + "FFFF") | (h.startswith("0" * 24) & (last > 0xFFFF))
    return F.when(F.octet_length(ip) == 4, _hexes(h, 0, 8)).when((F.octet_length(ip) == 16) & held, last)


def address_global(ip: Column) -> Column:
    """Is the address routed globally? That of a tunnel is judged by the IPv4 address inside; bytes that are no address are not."""
    h, plain = F.hex(ip), inner_ipv4(ip)
    last = _hexes(h, 24, 8)
    tunnel = F.when(h.startswith("20010000"), F.lit(0xFFFFFFFF) - last).when(h.startswith("2002"), _hexes(h, 4, 8)).when(h.startswith("0064FF9B" + "0" * 16), last)
    reserved = reduce(lambda a, b: a | b, (h.startswith(x) for x in _RESERVED_V6))
    wide = F.when(tunnel.isNotNull(), ipv4_global(tunnel)).otherwise(h.substr(1, 1).isin("2", "3") & ~reserved)
    return F.coalesce(F.when(plain.isNotNull(), ipv4_global(plain)).when(F.octet_length(ip) == 16, wide), F.lit(False))


def address_network(ip: Column) -> Column:
    """An IPv4 /24, tagged, or an IPv6 /48, as a number; null for bytes that are no address."""
    plain = inner_ipv4(ip)
    return F.when(plain.isNotNull(), source_network(plain)).when(F.octet_length(ip) == 16, _hexes(F.hex(ip), 0, 12))


# --- distances of 160-bit ids

def _words(id_: Column) -> list[Column]:
    """Five 32-bit words of a 20-byte id."""
    return [F.conv(F.hex(F.substring(id_, 4 * i + 1, 4)), 16, 10).cast("long") for i in range(5)]


def xor_distance(a: Column, b: Column) -> Column:
    """20 bytes; compares as unsigned, as binary does."""
    return F.unhex(F.concat(*(F.lpad(F.hex(x.bitwiseXOR(y)), 8, "0") for x, y in zip(_words(a), _words(b)))))


def common_prefix(a: Column, b: Column) -> Column:
    """Leading bits that two ids share, 0 to 160."""
    found = F.lit(160)
    for i, (x, y) in reversed(list(enumerate(zip(_words(a), _words(b))))):
        z = x.bitwiseXOR(y)
        found = F.when(z != 0, F.lit(32 * i + 32) - F.length(F.bin(z))).otherwise(found)
    return found.cast("int")
