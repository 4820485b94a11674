"""Small inputs that every operator must bear."""

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight"),
    (2, None),
    (3, ""),
    (4, " \t\n\r\x0b\x0c "),
    (5, "é" * 3 + " Ünïcode ÀÉ 日本語 текст 𝔸 ﬁ"),
    (None, "a row without an id has words too"),
    (7, "same text here\nsame text here\nsame text here\nsame text here"),
    (7, "same text here\nsame text here\nsame text here\nsame text here"),
    (8, "<|endoftext|> and <|startoftext|>it's'LL we've \x00 ퟿ ￿ 12345"),
    (9, "word " * 60_000),
    (10, "x" * 50_000),
    (11, "\n\n\na\n\n\nb\n\n\n"),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if not extra:
        return df
    from pyspark.sql import functions as F

    clash = ["n_tokens", "n_words", "score", "kept", "bands", "label", "node", "hit_flags", "tie", "signature", "component_id", "batch_id", "h1", "row", "gone"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
