"""Small inputs with the awkward rows that every operator has to stand."""

from gridloom.llm import queries as q

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double"

LONG = "lorem ipsum dolor sit amet " * 8000


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "one two three four five six seven eight", "en", "a", 39, 9, 0.5),
        (2, None, "en", "a", None, 9, 0.5),
        (3, "", "en", "b", 0, 9, 0.5),
        (4, "   \n\t ", None, None, 6, None, None),
        (5, LONG, "en", "b", len(LONG), 9, 0.5),
        (6, "one two three four five six seven eight", "en", "a", 39, 9, 0.5),
        (6, "one two three four five six seven eight", "en", "a", 39, 9, 0.5),
        (None, "mail me.now@host.example or +1 (843) 555-7672 please", "en", None, 10, 9, 0.5),
        (8, "日本語 テキスト 🙂🙂 <|endoftext|> naïve", "ja", "c", 30, 9, 0.5),
        (9, "!!! ### ???", "en", "c", 11, 9, 0.5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_tables(spark, tmp_path, **tables):
    """A folder of the given tables, for queries."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


QUERIES = q.queries()
