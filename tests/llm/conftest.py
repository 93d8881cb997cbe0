import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, k string, n int, component_id bigint, kept boolean, text_sha256 string, digest string, salt int, host string, rank int, copies int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, lang, source, None if t is None else len(t), 7, 0.5, "x", 1, 99, False, "z", "d", 3, "h", 4, 5) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty and white texts, a very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r", "en", "a"), (4, long, "en", "b"), (5, long, "en", "b"), (None, "no id here at all, friend", "en", None), (None, None, None, "a"), (6, "twice the same text in two rows", "en", "a"), (6, "twice the same text in two rows", "en", "a"), (7, "short", "en", "a"), (8, "SHORT", "en", "a"), (9, "\x00 ünïcode 日本語 😀 text", "xx", "ü")]
    return docs_of(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, [])
