import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"

#: Awkward rows: nulls, empties, ties, repeated rows, a very long text, odd characters.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three four five six seven eight nine ten"), (6, "one two  three\nfour five six seven eight nine ten"),
    (7, "One Two Three Four Five Six Seven Eight Nine Ten"), (8, "é" * 700), (9, "word " * 30_000), (9, "word " * 30_000), (None, "no id"), (None, "no id"), (None, None),
    (10, "a\x0bb\x0cc\x1cd\x1fe"), (11, "a b c d e"), (12, "mail jo@ex.org call +1 (414) 555-7134 or 414.555.7134 4146510152328576 10.0.0.1"), (13, "\U0001f600 \U0001f600 tail "), (14, "<|endoftext|> x <|startoftext|>"),
    (2**40, "big id"), (-5, "negative id"),
]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Makes a stored table folder from documents (and other tables) given as rows."""

    def make(documents, benchmark=(), labels=(), conversations=(), extra=False):
        path = tmp_path_factory.mktemp("tables")
        rows = [(i, t, "en", "s", len(t or "")) for i, t in documents]
        docs = spark.createDataFrame(rows, DDL)
        if extra:
            docs = docs.selectExpr("*", "1 as row_id", "'x' as name", "2 as n", "3 as f0", "4 as score", "5 as h", "'y' as component_id", "6L as shard", "7L as slot", "8 as w", "9L as start")
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
        return str(path)

    return make


@pytest.fixture(scope="session")
def odd(tables):
    return tables(ODD, benchmark=[(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (None, "big id")], extra=True)


@pytest.fixture(scope="session")
def empty(tables):
    return tables([])
