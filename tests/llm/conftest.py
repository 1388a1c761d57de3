import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, draw string, found string, label string"


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "und", "le", "Ünï", "under", "mit", "license", "x", "中文", "ﬁ", "İ", "don't", "!!", "1,2"]
    texts = [None, "", " \t\n", "a", "Under the MIT License", "under the mit license under the mit license, apache license version 2.0; CC BY-NC 4.0", "a b\na b\n\na b", "word " * 3000, "q" * 5000, "one two three four five " * 3 + "six"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None, "c", "c", "c", "c", "c") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id here", "en", "s1", 1, *"ccccc"), (None, None, None, None, None, *"ccccc"), (0, "same id as another", "en", "s0", 1, *"ccccc"), (900, texts[20], "en", None, 1, *"ccccc"), (901, texts[20] + " more", "en", None, 1, *"ccccc")]
    path = str(tmp_path_factory.mktemp("tables") / "awkward")
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
