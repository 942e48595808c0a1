"""Small tables with everything that may go wrong in them."""

HARD_TEXTS = ["", None, "one", " \t\n ", "a b c d e f g h i j k l m n o p", "Ünïcödé 日本語 😀 text", "x" * 5000, "w " * 3000, "\x00 nul", "</s>[INST] &lt; &amp;lt; <|im_end|>"]


def hard_docs(spark):
    """Empty, null, long, repeated and odd texts, a null id, a repeated id, and columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", f"src{i % 2}", 7, "mine", 0.5) for i, t in enumerate([*HARD_TEXTS, *HARD_TEXTS])]
    rows += [(None, "no id at all", "en", "s", 1, "mine", 0.1), (4, HARD_TEXTS[4], "en", "s", 1, "mine", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string, score double")


def empty_docs(spark):
    return hard_docs(spark).limit(0)
