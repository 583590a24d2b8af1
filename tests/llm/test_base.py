from evalforge.llm import _base


def test_staged_tables_can_be_released(spark):
    _base.release(spark)
    d = _base.staged(spark.range(5))
    assert d.count() == 5
    assert _base.release(spark) == 1 and _base.release(spark) == 0


def test_unique_name(spark):
    d = spark.createDataFrame([(1, 2)], "Key int, key_ int")
    assert _base.unique_name(d, "key") == "key__"


def test_pieces_hold_all_rows(spark):
    d = spark.range(1000).selectExpr("id", "cast(id as string) text")

    def count(batches):
        for part, texts in _base.pieces(batches):
            assert part.num_rows == len(texts) <= _base.ROWS_AT_ONCE
            yield _base.arrow(n=[len(texts)])

    assert sum(r.n for r in d.mapInArrow(count, "n long").collect()) == 1000
