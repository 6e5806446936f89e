import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, matches string, score double, bucket int"


@pytest.fixture
def docs(spark):
    """Builds documents of (doc_id, text[, source]) with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "m", 0.5, 3) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(12_000))
#: Nulls, empty and very long texts, ties, repeated rows, odd characters.
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "The quick brown fox jumps over the lazy dog"), (5, "The quick brown fox jumps over the lazy dog"), (6, LONG), (7, LONG + " end"), (None, "no id here at all"), (8, "é́ 中文 🙂 <|endoftext|>"), (9, "####")]
