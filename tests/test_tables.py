import pytest
from pyspark.errors import PySparkException

from sourcelens.functions import tables
from sourcelens.operators import symbols


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.rs", "pub fn one() { two(); }\nfn two() {}\n", 1), ("b.py", "def f(x):\n    return g(x)\n", 2), ("c.txt", "fn no() {}", 3), (None, "fn x() {}", 4), ("d.rs", None, 5)]
    df = spark.createDataFrame(rows, "path string, text string, owner int")
    df.createOrReplaceTempView("some_files")
    tables.register(spark)
    return df


def test_facts_from_sql(spark, files):
    got = spark.sql("select path, fact, name, kind, line, truncated from file_facts(table(some_files))")
    assert sorted(map(str, got.collect())) == sorted(map(str, symbols.syntax_facts(files, 99, 99).collect())) and got.count() > 3


def test_columns_are_kept_and_joined(spark, files):
    got = spark.sql("select owner, count(*) n from file_facts(table(select path, text, owner from some_files where path like '%.rs'), keep => 'owner', most => 1) where truncated or fact = 'symbol' group by owner").collect()
    assert [(r["owner"]) for r in got] == [1]
    assert spark.sql("select * from file_facts(table(some_files), most => 1)").where("fact = 'symbol' and path = 'a.rs'").collect()[0]["truncated"]


@pytest.mark.parametrize("call", ["file_facts(table(select path from some_files))", "file_facts(1)", "file_facts(table(some_files), keep => 'nothing')", "file_facts(table(some_files), most => -1)"])
def test_what_does_not_fit_is_refused(spark, files, call):
    with pytest.raises(PySparkException):
        spark.sql(f"select * from {call}").collect()
