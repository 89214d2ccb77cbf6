from prematch.sources import frozen as Z


def table(spark, n):
    return spark.createDataFrame([((i * 7919) % n, f"v{i}") for i in range(n)], "k LONG, v STRING").repartition(5)


def test_walk_sees_every_row_once_and_in_order(spark, tmp_path):
    df, path = table(spark, 1000), str(tmp_path / "f")
    Z.freeze(df, path, ["k"], part_rows=130)
    for limit in (90, 400):
        seen, after, opened = [], None, []
        while True:
            opened.append(len(Z.page_rows(spark, path, ["k"], limit, after).inputFiles()))
            rows, after = Z.listing_page(spark, path, ["k"], limit, after)
            seen += [(r["k"], r["v"]) for r in rows]
            if after is None:
                break
        assert seen == sorted((r["k"], r["v"]) for r in df.collect())
        assert max(opened) <= 2 + 2 * limit // 100  # the last pages open no more than the first ones


def test_later_rows_stay_outside(spark, tmp_path):
    df, path = table(spark, 50), str(tmp_path / "f")
    Z.freeze(df.filter("k < 40"), path, ["k"], part_rows=10)
    rows, after = Z.listing_page(spark, path, ["k"], 30, (20,))
    assert [r["k"] for r in rows] == list(range(21, 40)) and after is None
    assert Z.listing_page(spark, path, ["k"], 5, (39,)) == ([], None)


def test_several_keys_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(a, b) for a in "xyz" for b in range(20)], "a STRING, b INT")
    Z.freeze(df, str(tmp_path / "two"), ["a", "b"], part_rows=7)
    rows, after = Z.listing_page(spark, str(tmp_path / "two"), ["a", "b"], 4, ("x", 17))
    assert [tuple(r) for r in rows] == [("x", 18), ("x", 19), ("y", 0), ("y", 1)] and after == ("y", 1)
    Z.freeze(df.limit(0), str(tmp_path / "none"), ["a", "b"])
    assert Z.listing_page(spark, str(tmp_path / "none"), ["a", "b"], 4) == ([], None)
