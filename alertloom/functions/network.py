"""IP addresses, traffic direction, connection state and host names."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from alertloom import constants as K
from alertloom.functions.text import let, non_empty

OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
STRICT_V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(parts, F.lit(i)).cast("long")
    return F.when(ip.rlike(STRICT_V4), value)


def _ranges(blocks: Iterable[str], literal: str) -> Column:
    """Constant array of (lo, hi) structs, first and last address of each block."""
    nets = [ipaddress.ip_network(b) for b in blocks]
    pairs = [
        f"struct({literal.format(int(n.network_address))} as lo, "
        f"{literal.format(int(n.broadcast_address))} as hi)"
        for n in nets
    ]
    return F.expr(f"array({', '.join(pairs)})")


def _v4_in(number: Column, blocks: Iterable[str]) -> Column:
    return F.exists(_ranges(blocks, "{}L"), lambda r: number.between(r["lo"], r["hi"]))


def _private_v4(number: Column) -> Column:
    return let(number, lambda n: _v4_in(n, K.PRIVATE_V4) & ~_v4_in(n, K.PUBLIC_V4_EXCEPTIONS))


def _dotted_tail_as_groups(text: Column) -> Column:
    """An IPv6 text with an IPv4 tail rewritten to hex groups; null for a bad tail."""
    dotted = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)

    def rewrite(tail: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        groups = let(ipv4_number(tail), lambda v4: F.concat(
            F.hex(F.shiftright(v4, 16)), F.lit(":"), F.hex(v4.bitwiseAND(0xFFFF))))
        return F.when(tail == "", text).otherwise(F.concat(head, groups))

    return let(dotted, rewrite)


def _groups(half: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(half.isNull() | (half == ""), none).otherwise(F.split(half, ":", -1))


def ipv6_hex(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, or null when it is not one."""
    def joined(groups: Column) -> Column:
        return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")

    def digits(sides: Column) -> Column:
        left, right, cuts = sides["left"], sides["right"], sides["cuts"]
        n = F.size(left) + F.size(right)
        valid = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & (
            ((cuts == 0) & (n == 8)) | ((cuts == 1) & (n <= 7))
        )
        return F.when(valid, F.concat(joined(left), F.repeat(F.lit("0000"), F.lit(8) - n),
                                      joined(right)))

    def split_sides(halves: Column) -> Column:
        return F.struct(
            _groups(F.get(halves, F.lit(0))).alias("left"),
            _groups(F.get(halves, F.lit(1))).alias("right"),
            (F.size(halves) - 1).alias("cuts"),
        )

    plain = F.regexp_extract(ip, r"^([^%]+)(%[^%]+)?$", 1)
    text = let(plain, _dotted_tail_as_groups)
    return let(let(F.split(text, "::", -1), split_sides), digits)


def _v6_in(digits: Column, blocks: Iterable[str]) -> Column:
    return F.exists(_ranges(blocks, "'{:032x}'"), lambda r: digits.between(r["lo"], r["hi"]))


def _private_v6(digits: Column) -> Column:
    def check(d: Column) -> Column:
        v4 = F.conv(F.substring(d, 25, 8), 16, 10).cast("long")
        own = _v6_in(d, K.PRIVATE_V6) & ~_v6_in(d, K.PUBLIC_V6_EXCEPTIONS)
        return F.when(d.startswith("0" * 20 + "ffff"), _private_v4(v4)).otherwise(own)

    return let(digits, check)


def is_private_ip(ip: Column) -> Column:
    """True for addresses that are not globally reachable; false for public or invalid ones."""
    answer = F.when(ip.rlike(STRICT_V4), _private_v4(ipv4_number(ip))).when(
        ip.contains(":"), _private_v6(ipv6_hex(ip))
    )
    return F.coalesce(answer, F.lit(False))


def traffic_direction(source: Column, dest: Column) -> Column:
    sides = F.struct(is_private_ip(source).alias("src"), is_private_ip(dest).alias("dst"))
    return let(
        sides,
        lambda s: F.when(s["src"] & ~s["dst"], "Egress")
        .when(~s["src"] & s["dst"], "Ingress")
        .when(s["src"] & s["dst"], "Lateral")
        .otherwise("Internet-to-Internet"),
    )


def conn_state_text(state: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in K.CONN_STATE_TEXT.items() for x in kv])
    unknown = F.format_string("Unknown State (%s)", F.coalesce(state, F.lit("None")))
    return F.coalesce(known[state], unknown)


def conn_assessment(state: Column) -> Column:
    failed = F.format_string(
        "Suspicious: Connection failed with state '%s', which may indicate scanning.", state
    )
    return F.when(state.isin(K.FAILED_CONN_STATES), failed).otherwise(
        "Informational: Standard connection recorded."
    )


def flow_ratio(sent: Column, received: Column) -> Column:
    """Bytes up over bytes down with one decimal; null where nothing came down."""
    return F.when(received > 0, F.round(F.coalesce(sent, F.lit(0)) / received, 1))


def is_direct_ip_host(host: Column) -> Column:
    return F.coalesce(host.rlike(K.DIRECT_IP_HOST), F.lit(False))


def bare_host(host: Column) -> Column:
    """The host name alone: without scheme, user, port, path and closing dots."""
    bare = F.regexp_replace(host, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//|[/?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^.*@", ""), r":\d*$|\.+$", "")


def text_before(text: Column, tail: Column) -> Column:
    """The text before a tail and its dot."""
    size = F.length(text) - F.length(tail) - 1
    return F.substring(text, F.lit(1), F.greatest(size, F.lit(0)))


def domain_parts(
    host: Column, suffixes: Iterable[str] | None = None, exact: bool = False
) -> Column:
    """Struct (subdomain, domain, suffix) of a host name.

    `suffixes` may be a full public suffix list, with its `*.` and `!` rules. Unless `exact`,
    a host of two or more labels without a listed suffix has its last label as the suffix.
    """
    plain: dict[int, list[str]] = {}
    wild: dict[int, list[str]] = {}
    negated: dict[int, list[str]] = {}
    for rule in suffixes if suffixes is not None else K.MULTI_LABEL_SUFFIXES:
        kind, name = plain, rule.lower()
        if name.startswith("!"):
            kind, name = negated, name[1:]
        elif name.startswith("*."):
            kind, name = wild, name[2:]
        kind.setdefault(name.count(".") + 1, []).append(name)
    deepest = max([1, *plain, *[k + 1 for k in wild]])

    def suffix_labels(bare: Column) -> Column:
        """How many labels the suffix has."""
        low = F.lower(bare)
        n = F.size(F.split(bare, r"\."))

        def tail(k: int) -> Column:
            return F.substring_index(low, ".", -k)

        size = F.when(bare.rlike(STRICT_V4), 0)
        for k, names in sorted(negated.items(), reverse=True):
            size = size.when((n >= k) & tail(k).isin(names), k - 1)
        for k in range(deepest, 0, -1):
            if k in plain:
                size = size.when((n >= k) & tail(k).isin(plain[k]), k)
            if k - 1 in wild:
                size = size.when((n >= k) & tail(k - 1).isin(wild[k - 1]), k)
        if not exact:
            size = size.when(n >= 2, 1)
        return size.otherwise(0)

    def split(bare: Column) -> Column:
        def with_suffix(suffix: Column) -> Column:
            rest = F.when(suffix == "", bare).otherwise(text_before(bare, suffix))

            def with_rest(r: Column) -> Column:
                domain = F.when(bare.rlike(STRICT_V4), bare).otherwise(
                    F.substring_index(r, ".", -1)
                )
                return F.struct(text_before(r, domain).alias("subdomain"), domain.alias("domain"),
                                suffix.alias("suffix"))

            return let(rest, with_rest)

        suffix = let(suffix_labels(bare), lambda k: F.coalesce(*[
            F.when(k == i, F.substring_index(bare, ".", -i)) for i in range(1, deepest + 1)
        ], F.lit("")))
        return let(suffix, with_suffix)

    return let(bare_host(host), split)


def registered_domain(host: Column, suffixes: Iterable[str] | None = None) -> Column:
    return let(domain_parts(host, suffixes),
               lambda p: F.concat_ws(".", p["domain"], p["suffix"]))


def sni_reputation(name: Column, suffixes: Iterable[str] | None = None) -> Column:
    """Reputation of a server name: trusted domain, then adware words, then benign words."""
    trusted = F.create_map(*[F.lit(x) for kv in K.TRUSTED_DOMAINS.items() for x in kv])
    low = F.lower(name)
    words = F.array_union(F.split(low, r"\."), F.split(low, "-"))

    def listed(found: Column, keywords: list[str]) -> Column:
        return F.arrays_overlap(found, F.array(*[F.lit(k) for k in keywords]))

    by_words = let(words, lambda w: F.when(listed(w, K.ADWARE_KEYWORDS), "Adware/Tracker")
                   .when(listed(w, K.BENIGN_KEYWORDS), "Likely Benign Infrastructure")
                   .otherwise("Unknown Reputation"))
    return F.when(non_empty(name).isNull(), "Unknown").otherwise(
        F.coalesce(trusted[registered_domain(name, suffixes)], by_words)
    )
