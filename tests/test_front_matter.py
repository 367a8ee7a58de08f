import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.sources import front_matter as Y
from corvex.sources.markdown import front_matter

WORD = st.one_of(
    st.sampled_from(["a", "plain text", "yes", "No", "null", "~", "12", "1.5", "0x1f", "2024-01-05", "12:30", "it's", 'say "so"', "a: b", "a #b", "#x", "- x", "-x", "[x]", "{x}", "é ü", "tail:", " lead", "trail ", "", "x\ny", "back\\slash", "true-ish", "@me", "%", "a,b", "*", "&", "|", ">", "!", "?", ":", "tab\tx", "\u2028", "=", "1e5", "+1", ".5", ".inf"]),
    st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=6),
)
LEAF = st.one_of(WORD, st.integers(-10**6, 10**6), st.booleans(), st.none())
KEY = st.sampled_from(["a", "title", "part_of", "two words", "é", "x-y", "yes", "12"])
TREE = st.dictionaries(KEY, st.recursive(LEAF, lambda x: st.lists(x, max_size=3) | st.dictionaries(KEY, x, max_size=3), max_leaves=6), max_size=5)


def clean(v):
    """Without lists right inside lists, which the reader of notes does not know."""
    if isinstance(v, dict):
        return {k: clean(x) for k, x in v.items()}
    if isinstance(v, list):
        return [clean(x) for x in v if not isinstance(x, (list, dict))]
    return v


@settings(max_examples=400, deadline=None)
@given(TREE)
def test_block_yaml_reads_back(tree):
    tree = clean(tree)
    text = "---\n" + "".join(f"{x}\n" for x in Y.block_lines(tree)) + "---\nbody\n"
    assert front_matter(text) == (tree, "body\n", None)


@settings(max_examples=300, deadline=None)
@given(TREE, TREE, st.lists(KEY, max_size=2))
def test_a_merge_reads_as_the_merged_tree(old, new, gone):
    old, new = clean(old), {k: v for k, v in clean(new).items() if v is not None} | dict.fromkeys(gone)
    text = "---\n# first\n" + "".join(f"{x}\n" for x in Y.block_lines(old)) + "# last\n---\nbody\n---\nmore"
    merged = Y.merge(text, new)
    want = {k: v for k, v in {**old, **new}.items() if k not in new or v is not None}
    got, body, error = front_matter(merged)
    assert (got, error) == (want, None) and merged.endswith("---\nbody\n---\nmore") and list(got) == [k for k in [*old, *[k for k in new if k not in old]] if k in want]
    kept = [x for k in old if k not in new for x in Y.block_lines({k: old[k]})]
    left = iter(merged.split("\n"))
    assert all(x in left for x in kept)  # untouched lines stand as they were, in order


def test_untouched_lines_keep_their_bytes():
    text = "---\r\ntitle:   'odd   spacing'  \r\n# a comment\r\n\r\ntags: [a,  b]\r\nnested:\r\n    deep: 1\r\n    # inside\r\n    more: 2\r\nlast: x\r\n---\r\nbody\r\n"
    got = Y.merge(text, {"tags": ["c"], "new": {"k": [1, "two"]}})
    assert got == text.replace("tags: [a,  b]\r\n", "tags:\r\n- c\r\n").replace("last: x\r\n", "last: x\r\nnew:\r\n  k:\r\n  - 1\r\n  - two\r\n")
    assert Y.merge(text, {"nested": None}) == text.replace("nested:\r\n    deep: 1\r\n    # inside\r\n    more: 2\r\n", "")
    assert Y.merge(text, {}) == text


def test_notes_without_and_with_unreadable_front_matter():
    assert Y.merge("\n\nbody", {"a": 1}, {"title": "T"}) == "---\ntitle: T\na: 1\n---\n\nbody"
    assert Y.merge("---\n---\nbody", {"a": "yes"}) == "---\na: 'yes'\n---\nbody"
    with pytest.raises(ValueError):
        Y.merge("---\na: 1\n    b: 2\n---\nx", {"a": 2})


def test_over_a_table(spark):
    notes = spark.createDataFrame([(1, "---\na: 1\n---\nx"), (2, "plain"), (3, None), (4, "---\na: 1\n   b: 2\n---\n"), (5, "same")], "path int, text string")
    ups = spark.createDataFrame([(i, json.dumps({"k": "v"})) for i in (1, 2, 3, 4)] + [(9, "{}")], "path int, updates string")
    got = {r.path: (r.text, bool(r.error)) for r in Y.merge_all(notes, ups).collect()}
    assert got == {1: ("---\na: 1\nk: v\n---\nx", False), 2: ("---\nk: v\n---\n\nplain", False), 3: ("---\nk: v\n---\n\n", False), 4: ("---\na: 1\n   b: 2\n---\n", True), 5: ("same", False)}
    assert Y.merge_all(notes.limit(0), ups).count() == 0
