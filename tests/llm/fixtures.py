"""Documents that are hard on every operator."""

from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from the hunters of the wood "
DOCS = [
    (1, PROSE * 6, "en"),
    (2, PROSE * 6, "en"),  # an exact copy
    (3, PROSE * 5 + "with a new end that nobody has seen before", "en"),
    (4, "", "en"),
    (5, None, "en"),
    (6, "short", None),
    (7, "der schnelle braune fuchs springt über den faulen hund und läuft dann in den wald " * 4, "de"),
    (8, "naïve café \U0001f600 ünïcödé text <|endoftext|> " * 3, "fr"),
    (9, "a " * 5000, "en"),
    (10, " \n\t ", "en"),
    (11, "x" * 70_000, "en"),
    (None, "a row without an id but with words", "en"),
    (6, "short", None),  # a repeated row
    (12, "write to jane.doe@mail.example.org or call +1 (555) 010-9999 from 10.0.0.1 card 4111 1111 1111 1111 now", "en"),
]
CLASHING = ["key", "pattern", "row", "chunk", "part", "rank", "length", "bucket", "spans", "grp", "node", "component", "n", "kept", "file", "item_id"]


def frame(spark, docs=DOCS):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    df = df.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return frame(spark, []).limit(0)
