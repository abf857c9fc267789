import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with the awkward cases: nulls everywhere, empty and repeated texts and rows, long texts, clashing columns."""
    long = " ".join(f"word{k % 97}" for k in range(30_000))
    base = " ".join(f"alpha{k}" for k in range(60))
    data = [
        (1, "Hello  world, this is a line\nshort\nshared line of text", "en", "src0", 10),
        (2, "shared line of text\nother things here\n\nSHARED LINE OF TEXT ", "en", "src0", 20),
        (3, None, None, None, None),
        (4, "", "fr", "src1", 0),
        (4, "", "fr", "src1", 0),
        (5, "Hello \tworld, this is a line\nshort\nshared line of text", "en", "src2", 7),
        (6, long, "en", "src0", len(long)),
        (7, long + " tail", "de", "src3", len(long)),
        (8, base, "en", "src9", 1),
        (9, base.replace("alpha30", "beta"), "en", "src9", 1),
        (9, base.replace("alpha30", "beta"), "en", "src9", 1),
        (10, " \t\n ", "es", "src4", 3),
        (None, "no number, but a line of its own\nshared line of text", "en", "src0", 5),
        (11, "é ü ñ 中文 🙂 ‍ x" + "\u00a0" + "y", "fr", "src5", 9),
        (12, base.upper(), "en", "src9", 1),
    ]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
