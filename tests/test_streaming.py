from biblioflux.streaming import arrivals


def run(df, mode="append"):
    name = f"out_{id(df)}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


DDL = "k string, ts timestamp, db string, ord long"


def test_streams_agree_with_tables(spark, rows, tmp_path):
    data = rows([("a", "2026-01-01 00:00:00", "x", 2), ("a", "2026-01-01 05:00:00", "x", 1), (None, "2026-01-02 00:00:00", "y", 3), ("b", "2026-02-20 00:00:00", "y", 4)], "k string, ts string, db string, ord long")
    data.selectExpr("k", "cast(ts as timestamp) ts", "db", "ord").write.parquet(f"{tmp_path}/in")
    table, stream = spark.read.parquet(f"{tmp_path}/in"), spark.readStream.schema(DDL).parquet(f"{tmp_path}/in")
    assert sorted(r["k"] for r in run(arrivals.first_arrivals(stream, "k", "ts"))) == ["a", "b"] == sorted(r["k"] for r in arrivals.first_arrivals(table, "k", "ts").collect())
    counted = arrivals.counts_by_window(table, "ts", "db").collect()
    assert sorted((r["db"], r["n"]) for r in counted) == [("x", 2), ("y", 1), ("y", 1)]
    assert sorted((r["db"], r["n"]) for r in run(arrivals.counts_by_window(stream, "ts", "db"), "complete")) == [("x", 2), ("y", 1), ("y", 1)]


def test_a_table_keeps_the_earliest_row(rows):
    data = [(f"k{k}", ts, db, k) for k in range(20) for ts, db in ((None, "undated"), ("2026-01-03 00:00:00", "later"), ("2026-01-01 00:00:00", "first"), ("2026-01-02 00:00:00", "next"))]
    data += [("only", None, "undated", 1), (None, "2026-01-01 00:00:00", "no key", 1)]
    df = rows(data, "k string, ts string, db string, ord long").selectExpr("ord", "k", "cast(ts as timestamp) ts", "db")
    got = arrivals.first_arrivals(df, "k", "ts")
    assert got.columns == df.columns
    assert {r["k"]: r["db"] for r in got.collect()} == {f"k{k}": "first" for k in range(20)} | {"only": "undated"} and got.count() == 21


def test_new_keys_are_registered_once(spark, rows):
    stored = {}

    def read():
        parts = list(stored.values())
        return spark.createDataFrame([r for p in parts for r in p], "k string, ord long") if parts else None

    def write(df, number):
        stored[number] = [tuple(r) for r in df.collect()]

    step = arrivals.append_new_keys(read, write, "k", "ord")
    step(rows([("a", 5), ("a", 3), ("", 1), (None, 1)], "k string, ord long"), 0)
    step(rows([("a", 1), ("b", 7)], "k string, ord long"), 1)
    assert stored == {0: [("a", 3)], 1: [("b", 7)]}
    again = dict(stored)
    del stored[1]
    step(rows([("a", 1), ("b", 7)], "k string, ord long"), 1)
    assert stored == again
