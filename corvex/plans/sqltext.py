"""DuckDB SQL for the text functions."""

from __future__ import annotations

from corvex.functions import text as X

STOPS = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))


def fold(x: str) -> str:
    out = f"translate(lower(coalesce({x}, '')), '{X.ACCENTED}', '{X.PLAIN}')"
    for a, b in X.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def stem(w: str) -> str:
    cut = f"(CASE WHEN length({w}) > 3 AND regexp_matches({w}, '[sx]$') AND NOT {w} LIKE '%ss' AND NOT regexp_matches({w}, '[0-9].$') THEN left({w}, length({w}) - 1) ELSE {w} END)"
    return (
        f"(CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN length({cut}) > 6 AND regexp_matches({cut}, '(tion|sion)$') THEN left({cut}, length({cut}) - 4)"
        f" WHEN length({cut}) > 5 AND {cut} LIKE '%ing' THEN left({cut}, length({cut}) - 3) ELSE {cut} END)"
    )


def terms(x: str) -> str:
    return f"[{stem('w')} for w in {words(x)} if w NOT IN ({STOPS})]"


def significant(x: str) -> str:
    return f"list_distinct([w for w in regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+') if length(w) >= 3 AND w NOT IN ({STOPS})])"


#: Formats of known tokens, words that name a secret, and what a secret looks like beside them.
TOKENS = "(sk-[A-Za-z0-9_-]{12,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|\\b[0-9]{8,10}:[A-Za-z0-9_-]{30,})"
NAMED = "(token|password|passwd|secret|api[ _-]?key|bearer|credential|private[ _-]?key)"
VALUE = "([:=]\\s*`?[^\\s`]{6,}`?|[A-Za-z0-9_+/=-]{24,})"


def secret(x: str) -> str:
    """Whether a line looks like a secret."""
    return f"(regexp_matches({x}, '{TOKENS}') OR regexp_matches({x}, '{NAMED}', 'i') AND regexp_matches({x}, '{VALUE}'))"


#: Fixed value.
MASK = "[line hidden: looks like a secret]"
