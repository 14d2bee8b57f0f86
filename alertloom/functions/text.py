"""String functions: decoding, content tagging, entropy, rounding texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from alertloom import constants as K

# Characters that count as blanks, or as the letters i and s, when case is ignored over Unicode.
ODD_BLANKS = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
ODD_LETTERS, PLAIN_LETTERS = "\u0131\u017f", "is"
# One of these must occur before a pattern is worth trying; they are cheap to look for.
PATTERN_MARKS = {
    "Classic SQLi": ["'", "union", "--", "/*", "*/"],
    "Time-based Blind": ["benchmark", "sleep"],
    "HTML Event Handler": ["onerror", "onload", "onmouseover"],
    "Web Shell Command in Parameter": ["="],
    "Suspicious Script in Uploads": ["/upload"],
}
CONTENT_REASONS = sorted([*K.CONTENT_PATTERNS, K.TRAVERSAL_REASON])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def either(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return either(text.contains(w) for w in words)


def labels(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))


def url_decoded(text: Column) -> Column:
    """Percent- and plus-decoding repeated until the text is stable, at most ten times.

    A `%` without two hex digits stays as it is. Rounds with nothing left to decode are skipped.
    """
    def one_round(acc: Column, _: Column) -> Column:
        whole = F.regexp_replace(acc, "%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(acc.rlike(r"\+|%[0-9A-Fa-f]{2}"), F.url_decode(whole)).otherwise(acc)

    rounds = F.sequence(F.lit(1), F.lit(K.DECODE_ROUNDS))
    decoded = F.when(text.rlike(r"[+%]"), F.reduce(rounds, text, one_round)).otherwise(text)
    return F.lower(decoded)


def folded(lowered: Column) -> Column:
    """Lower-case text with unusual blanks and letters replaced by their plain forms.

    Patterns can then be matched byte-wise and case-sensitively with the same outcome.
    """
    odd = ODD_LETTERS + ODD_BLANKS
    plain = PLAIN_LETTERS + " " * len(ODD_BLANKS)

    def replaced(x: Column) -> Column:
        # Most texts fail the first test, nearly all others the second.
        suspect = x.rlike(r"[^\x00-\x1b\x20-\x7f]") & contains_any(x, odd)
        return F.when(suspect, F.translate(x, odd, plain)).otherwise(x)

    return let(lowered, replaced)


def content_mask(content: str, is_uri: bool) -> Column:
    """Reasons found in a column of decoded, folded content, one bit each (`CONTENT_REASONS`).

    The column is named once, so that merged projections do not decode it once per pattern.
    """
    def any_of(words: Iterable[str]) -> str:
        return "(" + " or ".join(f'contains(c, r"{w}")' for w in words) + ")"

    bits = []
    for bit, reason in enumerate(CONTENT_REASONS):
        pattern = K.CONTENT_PATTERNS.get(reason)
        if pattern is None:
            if not is_uri:
                continue
            hit = any_of(K.TRAVERSAL_MARKS)
        elif not re.search(r"[\\()\[\]{}*+?.^$]", pattern):
            hit = any_of(pattern.split("|"))
        else:
            # (?d): a dot matches everything but a line feed.
            hit = f'c rlike r"(?d){pattern}"'
            if reason in PATTERN_MARKS:
                hit = f"{any_of(PATTERN_MARKS[reason])} and {hit}"
        bits.append(f"if({hit}, {1 << bit}, 0)")
    return F.expr(f"get(transform(array({content}), c -> {' + '.join(bits)}), 0)")


def has_reason(mask: Column, *reasons: str) -> Column:
    bits = sum(1 << CONTENT_REASONS.index(r) for r in reasons)
    return mask.bitwiseAND(bits) != 0


def mask_reasons(mask: Column) -> Column:
    return labels(*[(has_reason(mask, r), r) for r in CONTENT_REASONS])


def shannon_entropy(text: Column) -> Column:
    """Base-2 entropy of the letters and digits of a text; 0 for none."""
    def of_chars(chars: Column) -> Column:
        n = F.size(chars)
        shares = F.transform(
            F.array_distinct(chars),
            lambda c: F.size(F.filter(chars, lambda y: y == c)) / n.cast("double"),
        )
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    kept = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    return F.when(text.rlike(r"[\p{L}\p{N}]"), let(F.split(kept, ""), of_chars)).otherwise(
        F.lit(0.0)
    )


def percent_text(part: Column, whole: Column) -> Column:
    return F.format_string("%d%%", F.bround(part * 100 / whole, 0).cast("long"))


def sentence(head: str, parts: Column, tail: str = ".") -> Column:
    return F.concat(F.lit(head), F.array_join(parts, ", "), F.lit(tail))


def agent_properties(agent: Column) -> Column:
    """Which of the three user-agent signatures apply; `Normal` for none."""
    found = let(F.lower(agent), lambda low: labels(
        (contains_any(low, K.ANOMALOUS_AGENTS), "Anomalous Pattern"),
        (contains_any(low, K.SCRIPTING_AGENTS), "Scripting/Tool Signature"),
        (contains_any(low, K.OUTDATED_AGENTS), "Outdated Browser Signature"),
    ))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("Normal"))))


def file_extension(name: Column) -> Column:
    """Lower-case last extension with its dot; leading dots of a name start no extension."""
    return F.lower(F.regexp_extract(name, r"(?s)^(?:.*/)?\.*[^./][^/]*(\.[^./]*)$", 1))


def normal_port(port: Column) -> Column:
    """Port text with `54066`, `'54066'` and `'54066.0'` alike; other texts unchanged."""
    text = port.cast("string")
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def content_hash(*values: Column) -> Column:
    """SHA-256 over the values in order, null as an empty text."""
    texts = F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.sha2(F.to_json(texts), 256)


def event_micros(message: Column) -> Column:
    """Event time inside the alert's JSON message, as epoch microseconds; null if unreadable."""
    stamp = F.try_to_timestamp(F.get_json_object(message, "$.timestamp"))
    return F.unix_micros(stamp)
