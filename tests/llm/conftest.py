import pytest

LINE = "the common line that stands in many documents of this small table and is long enough"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    body = " ".join(f"w{i}" for i in range(90))
    return [
        (0, body), (1, None), (2, ""), (3, body), (3, body), (4, " \n\t "), (5, "x" * 200_000), (6, "à" * 80 + LINE), (7, LINE + "é" * 60), (8, "🙂 " * 70),
        (None, body + " tail"), (9, "word " * 60), (10, "a\0b\0" + LINE), (11, "\n".join([LINE] * 4)),
    ]
