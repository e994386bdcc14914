"""Patterns of key-shaped text. A match is reported by name, length and head only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heirloom.functions.text import let

# Key variables whose assignment counts as a secret.
KEY_VARIABLES = ("TOGETHER_API_KEY", "OPENAI_API_KEY", "OAI_API_KEY", "ANTHROPIC_API_KEY")


def secret_patterns(min_token_hex: int = 64) -> list[tuple[str, str]]:
    """Named patterns in the order they are tried. Syntax common to Java and RE2."""
    hexes = f"[0-9A-Fa-f]{{{min_token_hex}}}"
    return [
        ("sk_prefix", r"\bsk-(?:ant-|or-)?[A-Za-z0-9_-]{16,}"),
        ("key_assignment", rf"(?:{'|'.join(KEY_VARIABLES)})\s*[=:]\s*\S+"),
        ("bearer_hex", rf"(?i:authorization)\s*:\s*(?i:bearer)\s+{hexes}"),
        ("token_hex", rf"(?i:token)\s*=\s*[\"']?{hexes}"),
        ("pem_block", r"-----BEGIN [A-Z0-9 ]*(?:KEY|CERTIFICATE)[A-Z ]*-----"),
    ]


def looks_like_secret(text: Column, min_token_hex: int = 64) -> Column:
    """Whether any pattern matches.

    A literal test guards each regex: nearly all text is cleared by plain
    substring searches and never meets the regex engine.
    """
    needles = {
        "sk_prefix": F.lit("sk-"),
        "key_assignment": F.lit("_API_KEY"),
        "pem_block": F.lit("-----BEGIN "),
    }
    hit = F.lit(False)
    for name, pattern in secret_patterns(min_token_hex):
        found = text.rlike(pattern)
        if name in needles:
            found = text.contains(needles[name]) & found
        hit = hit | found
    return hit


def secret_report(text: Column, min_token_hex: int = 64) -> Column:
    """``{pattern_name, match_length, head}`` of the first matching pattern, else NULL."""

    def describe(name: str, pattern: str) -> Column:
        return let(
            F.regexp_extract(text, f"({pattern})", 1),
            lambda m: F.when(
                m != "",
                F.struct(
                    F.lit(name).alias("pattern_name"),
                    F.length(m).alias("match_length"),
                    F.substring(m, 1, 4).alias("head"),
                ),
            ),
        )

    return F.coalesce(*[describe(n, p) for n, p in secret_patterns(min_token_hex)])
