"""One row of each component stays, also where ids are null or repeat."""

from framequery.llm import ngram_join


def test_keep_one_by_row(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    long = " ".join(f"w{i}" for i in range(100))
    docs = [(None, a), (None, a), (7, a), (None, b), (None, b), (1, c), (2, c), (2, "clean text of its own here"), (3, long), (3, long + " end"), (4, ""), (4, ""), (None, ""), (None, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = [(r["doc_id"], r["text"]) for r in kept if (r["text"] or "").split()]
    assert sum(x[1].startswith("w0 ") and x[0] == 3 for x in got) == 1
    assert sorted((x for x in got if x[0] != 3), key=str) == sorted([(7, a), (None, b), (1, c), (2, "clean text of its own here")], key=str)
    assert len(kept) == len(got) + 3
