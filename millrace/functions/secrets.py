"""Secrets in text: found by patterns, also inside Base64 and percent-encoded layers; redacted in place."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that both Java and RE2 read alike.
PATTERNS: dict[str, str] = {
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "bearer": r"(?i)bearer +[A-Za-z0-9._~+/-]{16,}=*",
    "assignment": r"(?i)(?:api[_-]?key|apikey|secret|password|passwd|pwd|token)[\"']?\s*[:=]\s*[\"']?[^\s\"',;]{6,}[\"']?",
}
#: Texts that match a pattern hold one of these: a search that costs less than the pattern.
HINTS: dict[str, tuple[str, ...]] = {
    "aws_key": ("AKIA", "ASIA"),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "jwt": ("eyJ",),
}
MASK = "***REDACTED***"
DEPTH = 3
#: A percent sign that codes nothing; it stands for itself.
_STRAY = r"%(?![0-9A-Fa-f]{2})"
_NOTHING = "\n"
_BASE64 = r"[A-Za-z0-9+/]{24,}={0,2}"


def _any(text: Column, patterns: Mapping[str, str]) -> Column:
    return reduce(lambda a, b: a | b, [_hinted(text, name, p) & text.rlike(p) for name, p in patterns.items()], F.lit(False))


def _hinted(text: Column, name: str, pattern: str) -> Column:
    """False only for texts that the pattern can't match. Patterns of any case have no hint: lower case costs as much."""
    if PATTERNS.get(name) != pattern or name not in HINTS:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [text.contains(x) for x in HINTS[name]])


def has_secrets(text: Column, depth: int = DEPTH, patterns: Mapping[str, str] = PATTERNS) -> Column:
    """True if a pattern matches the text, or what up to `depth` layers of percent or Base64 coding hide; null is false.

    A Base64 run is looked into only if it decodes to valid UTF-8, so hexadecimal digests are no false alarms; key ids
    that begin with AKIA are never decoded.
    """

    def look(layer: Column, left: int) -> Column:
        found = _any(layer, patterns)
        return found if left == 0 else found | _once(_below(layer), lambda x: F.when(x == _NOTHING, _any(x, patterns)).otherwise(look(x, left - 1)))

    return look(F.coalesce(text, F.lit("")), depth)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often `use` names it: a plan would repeat it at each place, a layer in a layer in a layer."""
    return F.transform(F.array(value), use)[0]


def _below(layer: Column) -> Column:
    """What a layer of coding hides; _NOTHING if there is none, as below that."""
    plain = F.coalesce(F.when(layer.contains("%"), F.try_url_decode(F.regexp_replace(layer, _STRAY, "%25"))), F.lit(""))
    runs = F.when(F.length(layer) >= 24, F.regexp_extract_all(layer, F.lit(f"({_BASE64})"), 1)).otherwise(F.array().cast("array<string>"))
    decoded = F.transform(
        F.filter(runs, lambda x: ~x.startswith("AKIA")),
        lambda x: F.coalesce(F.try_validate_utf8(F.try_to_binary(F.substring(x, F.lit(1), (F.floor(F.length(x) / 4) * 4).cast("int")), F.lit("base64")).cast("string")), F.lit("")),
    )
    return F.concat_ws("\n", plain, F.array_join(decoded, "\n"))


def has_plain_secrets(text: Column, patterns: Mapping[str, str] = PATTERNS) -> Column:
    """has_secrets() without decoding."""
    return _any(F.coalesce(text, F.lit("")), patterns)


def redact(text: Column, patterns: Mapping[str, str] = PATTERNS) -> Column:
    """The text with every plain match replaced by the mask; null stays null."""
    for name, p in patterns.items():
        text = F.when(_hinted(text, name, p), F.regexp_replace(text, p, MASK)).otherwise(text)
    return text
