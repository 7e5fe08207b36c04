import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in a is that it for on was with as be by this are or an river stone cloud bright seven maps".split()
LONG_WORD = "x" * 3000


def prose(seed: int, count: int) -> str:
    """Sentences of made-up order, the same for the same seed."""
    state, out = seed * 7919 + 13, []
    for i in range(count):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[state // 65536 % len(WORDS)] + (".\n" if i % 17 == 16 else ""))
    return " ".join(out)


SHARED = prose(99, 70)

ODD_ROWS = [
    (1, prose(1, 120), "en", "a"),
    (2, prose(2, 90) + " " + SHARED, "en", "a"),
    (3, prose(1, 120), "en", "b"),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \t\n\x0b\x0c\r ", "fr", None),
    (7, "one two", None, None),
    (8, LONG_WORD, "en", "a"),
    (9, SHARED + "\n" + prose(3, 80), None, "a"),
    (10, prose(1, 118) + " changed end", "en", "a"),
    (11, "Größe ändert sich für die Straße und das Maß der Dinge in der Stadt", "de", "c"),
    (12, "le château et la forêt où l'on va pour être près de la rivière", "fr", "c"),
    (13, "Größe ändert sich für die Straße und das Maß der Dinge in der Stadt", "de", "c"),
    (14, "é H̱ <|endoftext|> <|ENDOFTEXT|> it's 42 ...    end", "en", "d"),
    (15, "a b c d e " * 60, "en", "d"),
    (None, prose(4, 60), "en", "d"),
    (17, prose(5, 60), "en", "d"),
    (17, prose(5, 60), "en", "d"),
    (18, "日本語の文章 " * 20, None, "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows and an extra column, as a table of two files."""
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    rows = spark.createDataFrame(ODD_ROWS, SCHEMA).withColumn("score", F.lit("clash")).withColumn("n_chars", F.length("text").cast("long"))
    rows.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents")
    spark.createDataFrame([], SCHEMA + ", n_chars long").write.parquet(path)
    return spark.read.parquet(path)
