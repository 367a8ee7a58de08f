"""Text functions as Columns: folding, words, stems, terms, tokens, slugs, wildcards, masks."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that fold to other letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "ı": "i"}

# Words that identify no note, folded.
STOP_WORDS = frozenset(
    """
    the and for are was were this that with from have has had not but you your all any can how what when where
    which who why will would could should about into over under than then them they their there here out off its
    our ours yours been being does did doing get got just like make made more most some such only own same too
    very again once also each few other now new old
    les des une dans pour avec sans sur sous plus mais donc car ont est sont etre avoir que qui quoi dont cette
    ces ses son leur leurs nos notre votre vos tout tous toute toutes comme aussi alors depuis entre vers chez
    deja fait faire comment pourquoi quand meme peu tres
    a an of to in on at by or is it as be if so no do le la de du un et en au aux ce ou ne pas se sa il elle on
    je tu nous vous ils elles mon ma mes ton ta tes y d l s qu
    """.split()
)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x) -> Column:
    """Lower case without Latin accents and ligatures; other non-ASCII signs become spaces. Precomposed
    Latin letters only: `fold_any` covers every script and decomposed text."""
    c = F.translate(F.lower(F.coalesce(_col(x), F.lit(""))), ACCENTED, PLAIN)
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[^\x00-\x7F\p{L}\p{N}]", " ")


def _fold_char(ch: str) -> str:
    if ch in LIGATURES:
        return LIGATURES[ch]
    bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.category(c).startswith("M"))
    return bare if bare and all(unicodedata.category(c)[0] in "LN" for c in bare) else " "


def fold_text(text: str | None) -> str:
    """The exact fold of one string, by canonical decomposition."""
    return "".join(c if c < "\x80" else _fold_char(c) for c in (text or "").lower())


@F.pandas_udf(T.StringType())
def fold_any(x: pd.Series) -> pd.Series:
    return x.map(fold_text)


def words(x) -> Column:
    return F.regexp_extract_all(fold(x), F.lit(r"([\p{L}\p{N}]+)"), 1)


#: Endings in two rounds, of which the first that a word has counts: the ending, the word's least length, letters that
#: go, letters that come, and signs that it must not follow.
DIGITS = "0123456789"
PLURALS = (("ies", 5, 3, "y", ""), ("s", 4, 1, "", "s" + DIGITS), ("x", 4, 1, "", DIGITS))
ENDINGS = (("tion", 7, 4, "", ""), ("sion", 7, 4, "", ""), ("ing", 6, 3, "", ""))


def _cut_ending(c: Column, rules) -> Column:
    out, n = c, F.length(c)
    for ending, least, goes, comes, not_after in reversed(rules):
        has = c.endswith(ending) & (n >= least)
        if not_after:
            has = has & ~F.substring(c, n - len(ending), F.lit(1)).isin(*not_after)
        cut = F.substring(c, F.lit(1), n - goes)
        out = F.when(has, F.concat(cut, F.lit(comes)) if comes else cut).otherwise(out)
    return out


def stem(w) -> Column:
    """Plural endings, then (unless a word in -ies) noun and verb endings."""
    w = _col(w)
    ies, least, *_ = PLURALS[0]
    return F.when(w.endswith(ies) & (F.length(w) >= least), _cut_ending(w, PLURALS[:1])).otherwise(_cut_ending(_cut_ending(w, PLURALS[1:]), ENDINGS))


def with_stem(df: DataFrame, word: str, term: str) -> DataFrame:
    """`df` with the stem of the column `word` in its place, as `term`: the two rounds one after the other, so that the
    first isn't computed again wherever the second asks for it."""
    ies, least, *_ = PLURALS[0]
    w, first = F.col(word), F.col("_first")
    of_ies = w.endswith(ies) & (F.length(w) >= least)
    cut = df.select(*[c for c in df.columns if c != word], of_ies.alias("_ies"), F.when(of_ies, _cut_ending(w, PLURALS[:1])).otherwise(_cut_ending(w, PLURALS[1:])).alias("_first"))
    return cut.select(*[c for c in df.columns if c != word], F.when(F.col("_ies"), first).otherwise(_cut_ending(first, ENDINGS)).alias(term))


def stem_word(w: str) -> str:
    """The same for one string, for the driver's side of a query."""
    for rules in (PLURALS, ENDINGS):
        for ending, least, goes, comes, not_after in rules:
            if len(w) >= least and w.endswith(ending) and w[-len(ending) - 1] not in not_after:
                w = w[: len(w) - goes] + comes
                if comes:
                    return w
                break
    return w


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(text))


STOP_STEMS = frozenset(map(stem_word, STOP_WORDS))


def is_stop(w: Column) -> Column:
    return w.isin(*sorted(STOP_WORDS))


def terms(x) -> Column:
    return F.transform(F.filter(words(x), lambda w: ~is_stop(w)), stem)


# Words that name a secret, what a secret looks like after them, and formats of known tokens.
SECRET_WORDS = ("token", "password", "passwd", "secret", "api[ _-]?key", "bearer", "credential", "private[ _-]?key")
SECRET_VALUES = (r"[:=]\s*`?[^\s`]{6,}`?", r"[A-Za-z0-9_+/=-]{24,}")
TOKEN_FORMATS = (
    r"sk-[A-Za-z0-9_-]{12,}", r"ghp_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"xox[abp]-[A-Za-z0-9-]{10,}", r"AKIA[0-9A-Z]{16}",
    r"\b\d{8,10}:[A-Za-z0-9_-]{30,}",
)
MASK = "[line hidden: looks like a secret]"


def looks_secret(line) -> Column:
    """A word that names a secret and a value like one, or a known token format."""
    line = _col(line)
    any_of = lambda patterns, flags="": line.rlike(flags + "|".join(f"(?:{p})" for p in patterns))
    return any_of(TOKEN_FORMATS) | any_of(SECRET_WORDS, "(?i)") & any_of(SECRET_VALUES)


def mask_secrets(x) -> Column:
    """Lines that look like a secret become MASK; headings keep their level."""
    line = lambda s: F.when(looks_secret(s), F.concat(F.regexp_extract(s, r"^(#{1,6}[ \t])?", 0), F.lit(MASK))).otherwise(s)
    return F.array_join(F.transform(F.split(_col(x), "\n"), line), "\n")


def significant_words(x) -> Column:
    """Distinct lower-case words of three or more characters, in order, without stop words and secrets."""
    found = F.regexp_extract_all(F.lower(mask_secrets(x)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~is_stop(w)))


def tokens(x) -> Column:
    """The size measure used throughout: bytes by four, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(_col(x), F.lit(""))) / 4).cast("bigint")


#: Replacements in order: what is no letter, digit or dot; runs of hyphens; hyphens and dots at the ends.
SLUG_RULES = ((r"[^\p{L}\p{N}.-]+", "-"), (r"-{2,}", "-"), (r"^[-.]+|-+$", ""))


def slugify(x, keep_slashes: bool = True) -> Column:
    """A path or name as a slug, a segment at a time; .md goes."""
    def segment(s: Column) -> Column:
        for pattern, new in SLUG_RULES:
            s = F.regexp_replace(s, pattern, new)
        return s

    path = F.regexp_replace(F.translate(fold(x), "\\", "/"), r"\.md$", "")
    if not keep_slashes:
        return segment(F.translate(path, "/", "-"))
    return F.array_join(F.filter(F.transform(F.split(path, "/"), segment), lambda s: s != ""), "/")


#: Letters and signs as ASCII, lower case; capitals follow.
TRANSLITERATED = {
    "œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i", "ĸ": "q", "ŉ": "'n", "ŋ": "ng", "ħ": "h", "ŧ": "t",
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": ",,", "«": "<<", "»": ">>", "‹": "<", "›": ">", "–": "-", "—": "--", "―": "--",
    "‐": "-", "‑": "-", "…": "...", "•": "*", "·": "*", "€": "EUR", "£": "PS", "¥": "Y=", "¢": "C/", "°": "deg", "©": "(c)", "®": "(r)", "™": "(tm)",
    "×": "x", "÷": "/", "½": " 1/2", "¼": " 1/4", "¾": " 3/4", "¹": "1", "²": "2", "³": "3", "º": "o", "ª": "a", "§": "SS", "¶": "P", "¿": "?", "¡": "!",
}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяєіїґў", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia ie i yi g u".split()))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split())) | {"ξ": "ks"}
CJK = "\u4e00-\u9fff\u3000-\u303f\u3400-\u4dbf"
_ASCII = TRANSLITERATED | CYRILLIC | GREEK
_ASCII |= {k.upper(): v.upper() if k in "œæß" else v.capitalize() for k, v in _ASCII.items() if k.isalpha() and len(k.upper()) == 1 and k.upper() != k}


def ascii_char(c: str) -> str:
    """A character as ASCII: by the tables, without its marks, by its compatible form, or dropped."""
    if c < "\x80":
        return c
    if c in _ASCII:
        return _ASCII[c]
    for form in ("NFD", "NFKD"):
        bare = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.category(x).startswith("M"))
        if bare and bare.isascii():
            return bare
        if bare in _ASCII:
            return _ASCII[bare]
    return " " if c.isspace() else ""


@F.pandas_udf(T.StringType())
def to_ascii(x: pd.Series) -> pd.Series:
    """Text as ASCII; Chinese and Japanese characters stay."""
    keep = re.compile(f"[{CJK}]").match
    return x.map(lambda t: None if t is None else "".join(c if c < "\x80" or keep(c) else ascii_char(c) for c in t))


def _bare_form(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")


#: Every letter or sign whose compatible form without marks is one ASCII sign, and that sign.
BARE = {c: _bare_form(c) for c in map(chr, range(0x80, 0x10000)) if len(_bare_form(c)) == 1 and _bare_form(c).isascii()}


def without_marks(x) -> Column:
    """Letters without their marks, full-width and other forms of ASCII signs as these; what has no such form stays."""
    return F.translate(F.regexp_replace(_col(x), "[\u0300-\u036f]", ""), "".join(BARE), "".join(BARE.values()))


def permalink(path) -> Column:
    """A note's path as its permalink: without its ending, in ASCII, camel-case words parted, lower case, hyphens
    between words, none at the ends of a segment."""
    p = F.regexp_replace(F.translate(_col(path), "\\", "/"), r"(?i)\.(md|markdown|txt)$", "")
    a = to_ascii(F.regexp_replace(p, "[\uff00-\uffef]", ""))  # full-width forms go
    a = F.regexp_replace(F.regexp_replace(a, f"([{CJK}])([a-zA-Z0-9])", "$1-$2"), f"([a-zA-Z0-9])([{CJK}])", "$1-$2")
    a = F.lower(F.regexp_replace(a, "([a-z0-9])([A-Z])", "$1-$2"))
    a = F.regexp_replace(F.regexp_replace(F.replace(F.translate(a, "_", "-"), F.lit("'"), F.lit("")), f"[^a-z0-9{CJK}/.-]", "-"), "-+", "-")
    return F.array_join(F.transform(F.split(a, "/"), lambda s: F.regexp_replace(s, "^-+|-+$", "")), "/")


def one_line(x, most: int = 200) -> Column:
    """White space collapsed; beyond `most` characters the last one becomes an ellipsis."""
    c = F.trim(F.regexp_replace(_col(x), r"\s+", " "))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


#: Kinds of notes that a slug begins with and a label leaves out, and what a slug looks like.
LABEL_KINDS = ("user", "feedback", "reference", "project", "doc", "note")
SLUG_FORM = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,150}$"


def human_label(slug, title=None) -> Column:
    """The title, unless it is the slug or looks like one; else the slug's words with a capital first letter, without the
    kind that it begins with."""
    s = _col(slug)
    c = F.trim(F.regexp_replace(F.regexp_replace(s, f"^({'|'.join(LABEL_KINDS)})[-_]", ""), r"[-_]+", " "))
    words = F.when(c == "", s).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20)))
    if title is None:
        return words
    t = _col(title)
    return F.when((t != "") & (t != s) & ~t.rlike(SLUG_FORM), t).otherwise(words)


def wildcard(pattern: str, within_segment: bool = False) -> str:
    """A case-insensitive regular expression for `*` and `?`."""
    any_char = "[^/]" if within_segment else "."
    body = "".join(any_char + "*" if c == "*" else any_char if c == "?" else re.escape(c) for c in pattern.lower())
    return f"(?is)^{re.sub(r'(?:' + re.escape(any_char) + r'\*)+', any_char + '*', body) if '*' in pattern else body}$"


def matches(x, pattern: str, within_segment: bool = False) -> Column:
    return _col(x).rlike(wildcard(pattern, within_segment))


def within_one_edit(a, b) -> Column:
    return F.levenshtein(_col(a), _col(b), 1) >= 0


def stable_id(x) -> Column:
    h = F.sha1(_col(x))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(nibble)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stable_int(x) -> Column:
    return F.conv(F.substring(F.sha1(_col(x)), 1, 7), 16, 10).cast("bigint")


def iso(ms) -> Column:
    """Milliseconds as an ISO instant."""
    return F.date_format(F.timestamp_millis(_col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def prefix_hash(index: Column, rules: Column) -> Column:
    """A hash of what is always loaded, of 16 characters."""
    both = F.concat(F.coalesce(index, F.lit("")), F.lit("\0"), F.coalesce(rules, F.lit("")))
    return F.substring(F.sha2(F.encode(both, "utf-8"), 256), 1, 16)


META_SKIPPED, META_DEPTH = ("title", "permalink", "description", "tags", "type"), 3


def _flat(value, depth: int) -> list[str]:
    if value is None or depth > META_DEPTH:
        return []
    if isinstance(value, dict):
        return [x for v in value.values() for x in _flat(v, depth + 1)]
    if isinstance(value, list):
        return [x for v in value for x in _flat(v, depth + 1)]
    return [str(value).lower() if isinstance(value, bool) else str(value)]


@F.pandas_udf(T.StringType())
def meta_text(front_matter: pd.Series) -> pd.Series:
    """The values of front matter (JSON) to a depth of three, without those that have fields of their own."""
    def one(x):
        try:
            data = json.loads(x) if x else {}
        except ValueError:
            return ""
        return " ".join(y for k, v in data.items() if k not in META_SKIPPED for y in _flat(v, 0)) if isinstance(data, dict) else ""

    return front_matter.map(one)


#: Words by which a tool's name tells what it does, anywhere in it, looked for in this order.
TOOL_WORDS = {
    "write": "write edit create update move rename delete remove append prepend replace patch insert save".split(),
    "search": "search find query grep glob recent".split(),
    "read": "read view fetch open show context load".split(),
}


def tool_kind(name) -> Column:
    """write, search or read by a tool's name; names that begin with get_ read; null for others, such as listings."""
    n = F.lower(F.coalesce(_col(name), F.lit("")))
    has = {k: sum((n.contains(w).cast("int") for w in words), F.lit(0)) > 0 for k, words in TOOL_WORDS.items()}
    return F.when(has["write"], "write").when(has["search"], "search").when(has["read"] | n.startswith("get_"), "read")


def register(spark) -> None:
    """SQL functions tok, fold_text, meta_text, and stem_word and terms of plain Latin text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tok(x STRING) RETURNS BIGINT RETURN CAST(ceil(octet_length(coalesce(x, '')) / 4) AS BIGINT)")
    spark.udf.register("fold_text", fold_any)
    spark.udf.register("meta_text", meta_text)
    stem_all = F.pandas_udf(lambda x: x.map(lambda w: None if w is None else stem_word(w)), T.StringType())
    terms_all = F.pandas_udf(lambda x: x.map(lambda t: [stem_word(w) for w in words_of(t or "") if w not in STOP_WORDS]), T.ArrayType(T.StringType()))
    spark.udf.register("stem_word", stem_all)
    spark.udf.register("terms", terms_all)
