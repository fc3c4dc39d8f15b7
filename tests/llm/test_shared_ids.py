from logsieve.llm.simhash import keep_one, near_duplicates


def test_components_that_share_their_least_id_both_keep_a_row(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (5, one), (1, other), (7, other), (1, other), (9, "something else at all here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, keep_one(docs, near_duplicates(docs)).collect())) == sorted([(1, one), (1, other), rows[-1]])
