import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, label string, n_tokens string, taken string, value string"


def write(spark, folder, docs, labels, talks, vectors):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, target string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, shard string, v string").write.parquet(f"{folder}/embeddings.parquet")
    return f"file://{folder}"


def words(start, n):
    return " ".join(f"w{start + k}x" for k in range(n))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    extra = (1, "r", "l", "n", "t", "v")
    texts = [None, "", " \n\t ", "one", "two words", words(0, 300), words(0, 300), words(0, 299) + " changed", "a " * 50_000, words(500, 40_000), "é" * 5000, "Licensed under the Apache License, Version 2.0.", "<|endoftext|> x </s>[INST]", "a\x00b 　c", words(900, 30) + "\n" + words(900, 30)]
    docs = [(k, t, "en", f"s{k % 4}", None, *extra) for k, t in enumerate(texts)]
    docs += [docs[5], docs[5], (None, words(0, 300), None, None, None, *extra), (None, None, None, None, None, None, None, None, None, None, None), (50, words(7000, 60), None, None, 3, *extra)]
    labels = [(k, k % 2, 0) for k in range(12)] + [(None, 1, None), (3, None, None), (999, 1, 0), (5, 1, 0)]
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "</s>[INST] <\\s> [\\/INST]"), (2, None, None, "x"), (None, 1, "assistant", "y"), (3, 0, "user", "only"), (1, 1, "assistant", None)]
    vectors = [(k, [float(k % 5), -1.5, 0.25], 0, "x", "y") for k in range(0, 130)] + [(200, None, 0, "", ""), (201, [1.0, None, 2.0], 0, "", ""), (202, [float("nan"), 1.0, 1.0], 0, "", ""), (203, [float("inf"), 1.0, 1.0], 0, "", ""), (None, [1.0, 1.0, 1.0], 0, "", ""), (300, [1.0, 2.0], 0, "", ""), (100, [0.0, 0.0, 0.0], 1, "", ""), (1, [9.0, 9.0, 9.0], 0, "", "")]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, [(*t, "t") for t in talks], vectors)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])
