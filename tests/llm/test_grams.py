import __spark_entry__ as e


def test_p2_counts_locations_once_and_marks(spark, tmp_path):
    rows = [
        (1, "Ab", 1, [3, 9]), (1, "ab", 1, [9, 3]), (2, "ab", 2, [1]), (1, "ab", 3, None),  # 3 occurrences in 2 of 3 documents
        (1, "q", 1, [1]), (1, "Q", 1, [1]), (1, "q", 1, [7]),  # 2 occurrences
        (1, "z", 3, [1, 2, 3]),  # neither: 3 occurrences in 1 of 3 documents
        (1, "É", 2, [5]),  # only ASCII letters are lower-cased
    ]
    spark.createDataFrame(rows, "shard_id bigint, gram string, doc_id bigint, locations array<int>").write.parquet(f"{tmp_path}/postings.parquet")
    got = {tuple(r) for r in e.queries()["p2_found"](spark, str(tmp_path)).collect()}
    assert got == {("ab", "common"), ("q", "rare"), ("É", "rare")}


def test_p2_agrees_with_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("create view postings as select * from '/root/testdata/sf0.01/postings.parquet'")
    want = set(c.sql(e.oracle_sql()["p2_found"]).fetchall())
    got = [tuple(r) for r in e.queries()["p2_found"](spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == len(want) and set(got) == want


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0
