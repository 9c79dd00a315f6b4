import pytest



@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that every document operator must take: nulls, empty and long texts, ties, repeats, clashing extra columns."""
    long_text = "word " * 40_000 + "ends."
    rows = [(1, "Same  text here."), (2, "Same text here."), (2, "Same text here."), (None, "Same\ttext here."), (3, None), (4, ""), (5, "   \n "), (6, long_text), (7, long_text), (None, None), (8, "é漢字😀\x00 <|endoftext|>")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, fp int, rank string")
    return df
