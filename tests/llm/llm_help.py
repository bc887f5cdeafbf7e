SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, start=0):
    """Documents with ids from `start`; a pair gives its own id."""
    rows = [(x if isinstance(x, tuple) else (start + i, x)) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
