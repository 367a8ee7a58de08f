from datetime import UTC, datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvex.functions import dates as D
from corvex.functions import text as X

NOW = int(datetime(2026, 3, 10, 12, tzinfo=UTC).timestamp() * 1000)


def one(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr).collect()]


def test_fold_matches_the_exact_fold(spark):
    texts = ["Été à l'Œuvre", "straße łódż"[:8], "naïve ñandú", "a→b", None, ""]
    assert one(spark, texts, X.fold("x")) == [X.fold_text(t) for t in texts]
    assert one(spark, ["cafe\u0301", "ŹDŹ", "ĀĒ"], X.fold_any("x")) == [X.fold_text(t) for t in ("cafe\u0301", "ŹDŹ", "ĀĒ")]


def test_stem(spark):
    ws = ["decisions", "decision", "deploying", "queries", "class", "bus", "v2s", "nations", "sing", "mission", "aux"]
    assert one(spark, ws, X.stem("x")) == [X.stem_word(w) for w in ws]
    assert X.stem_word("decisions") == X.stem_word("decision") == "deci"
    assert X.stem_word("queries") == "query"


@settings(max_examples=20, deadline=None)
@given(st.text("abisx ngto", max_size=12))
def test_words_of_has_only_words(t):
    assert all(w and " " not in w for w in X.words_of(t))


def test_terms_and_significant_words(spark):
    assert one(spark, ["The decisions of the deploying teams"], X.terms("x")) == [["deci", "deploy", "team"]]
    assert one(spark, ["Alpha alpha be BETA\npassword: hunter2"], X.significant_words("x")) == [["alpha", "beta", "line", "hidden", "looks", "secret"]]


def test_secrets(spark):
    lines = ["Authorization: Bearer abcdef123456", "-----BEGIN PRIVATE KEY: abcdefgh", "github_pat_0123456789abcdefghij", "12345678:" + "a" * 30, "password: hunter2", "the passphrase: longer words", "a token of thanks", "## secret = `abcdef`", "sk-abcdefghijkl"]
    assert one(spark, lines, X.looks_secret("x")) == [True, True, True, True, True, False, False, True, True]
    assert one(spark, ["## secret = `abcdef`\nplain"], X.mask_secrets("x")) == ["## " + X.MASK + "\nplain"]


def test_tokens_slug_wildcard(spark):
    assert one(spark, ["", None, "abcd", "é"], X.tokens("x")) == [0, 0, 1, 1]
    assert one(spark, ["docs/My Feature.md", "Été  2026!"], X.slugify("x")) == ["docs/my-feature", "ete-2026"]
    assert one(spark, ["docs/a.md", "docs/x/a.md", "DOCS/B.MD"], X.matches("x", "docs/?.md")) == [True, False, True]
    assert one(spark, ["docs/a", "docs/x/a"], X.matches("x", "docs/*", within_segment=True)) == [True, False]
    assert one(spark, ["kitten", "kittens", "kit"], X.within_one_edit("x", F.lit("kitten"))) == [True, True, False]


def test_one_line(spark):
    assert one(spark, ["a\n  b", "x" * 300], X.one_line("x")) == ["a b", "x" * 199 + "…"]


def test_parse_timeframe():
    day = D.DAY
    assert D.parse_timeframe("7d", NOW) == D.parse_timeframe("7", NOW) == D.parse_timeframe(7, NOW) == NOW - 7 * day
    assert D.parse_timeframe("two weeks ago", NOW) == NOW - 14 * day
    assert D.parse_timeframe("last month", NOW) == NOW - 30 * day
    assert D.parse_timeframe("yesterday", NOW) == NOW - 12 * 3_600_000 - day
    assert D.parse_timeframe("2026-01-05", NOW) == D.parse_timeframe("Jan 5", NOW) == D.parse_timeframe("5th january 2026", NOW)
    assert D.parse_timeframe("dec 25", NOW) == int(datetime(2025, 12, 25, tzinfo=UTC).timestamp() * 1000)
    assert D.parse_timeframe("whenever", NOW) is None and D.parse_timeframe(None, NOW) is None


def test_parse_timeframe_forms():
    ms = lambda *d: int(datetime(*d, tzinfo=UTC).timestamp() * 1000)
    cases = {
        "1.5 days": NOW - 36 * 3_600_000, "an hour ago": NOW - 3_600_000, "past 2 weeks": NOW - 14 * D.DAY, "this year": NOW - 365 * D.DAY, "3mo": NOW - 90 * D.DAY,
        "march 5th, 2024": ms(2024, 3, 5), "5 mar 2024": ms(2024, 3, 5), "mon": None, "2026-13-01": None, "2026-01-05T06:00:00Z": ms(2026, 1, 5, 6), "2026-01-05 06:00": ms(2026, 1, 5, 6),
        "now": NOW, "32 jan": None, "": None, "5 apples": None,
    }
    for text, want in cases.items():
        assert D.parse_timeframe(text, NOW) == want, text


def test_heading_dates(spark):
    titles = ["2026-10-12 review", "5/11/2026", "Notes 5/10 soir", "12 oct.", "Oct 12, 2026", "3 février", "Chapter 13/45", "plain"]
    more = {
        "12 oct - 5 nov 2026": (None, 10, 12), "Sept. 5th, 2025 plan": (2025, 9, 5), "as of 1 AOÛT 2024": (2024, 8, 1), "5 mars.": (None, 3, 5), "v12/10x": None, "1234-5-6": None, "2026-10-12 and 1/2": (2026, 10, 12),
        "may 32": None, "10/2026": None, "état au 31/12 à 10h": (None, 12, 31), "12  oct 2026": (2026, 10, 12), "x_12 oct": None, "12 oct. 2026": (2026, 10, 12), "40 mai 5": (None, 5, 5), "": None,
    }
    assert [tuple(g) if g else None for g in one(spark, list(more), D.heading_date(F.col("x")))] == list(more.values())
    got = one(spark, titles, D.heading_date(F.col("x")))
    assert [tuple(g) if g else None for g in got] == [(2026, 10, 12), (2026, 11, 5), (None, 10, 5), (None, 10, 12), (2026, 10, 12), (None, 2, 3), None, None]


def test_infer_years(spark):
    df = spark.sql("SELECT array(named_struct('year', CAST(NULL AS INT), 'month', 11, 'day', 3), named_struct('year', CAST(NULL AS INT), 'month', 2, 'day', 1)) AS d")
    got = df.select(D.infer_years(F.col("d"), F.lit(NOW))).first()[0]
    assert [datetime.fromtimestamp(t / 1000, UTC).date().isoformat() for t in got] == ["2025-11-03", "2026-02-01"]
