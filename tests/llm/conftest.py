"""Small tables with every case that the operators define."""

import pytest
from pyspark.sql import Row

LONG = " ".join(f"word{i % 977} the of and" for i in range(12_000))

CLASHING = (
    "kept keep_id group_size text_sha256 piece start length ids ids_crc32 sequence_id offset size shard slot law bucket key sha chain fp th "
    "component_id fingerprint n_words posterior label score entity surrogate source_ n draw news pos n_entities n_lines n_removed"
).split()

TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one two"),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (7, "line a here\nline b here\nline c here\nline d here"),
    (8, "intro words\nline a here\nline b here\nline c here\noutro"),
    (9, LONG),
    (10, "Ünïcödé naïve ß ﬁ 漢字 かな 🙂 end. <|endoftext|>  x y  z"),
    (11, "mail bob.smith12@mail7.example.com or +1 (017) 555-7713, card 4111111111111111 from 97.51.17.173"),
    (12, "Mail BOB.SMITH12@MAIL7.EXAMPLE.COM now, says Mr. Smith and Mrs. Jones; Mr. John Smith agrees"),
    (None, "no id at all but some words to read here and more of them"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHING}).withColumn("a.b", F.lit(1))


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


def strip(rows):
    return sorted((tuple(r) for r in rows), key=repr)
