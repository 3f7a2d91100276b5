"""The catalog's fingerprint counts the files of its books, whether they are one or several."""

from pathlib import Path

from tessera.plans import registry

DATA = Path("/root/testdata/sf0.001")


def test_fingerprint_counts_files(spark, tmp_path):
    one = registry.QUERIES["index_fingerprint"](spark, str(DATA))
    assert one.dtypes == [("books", "bigint"), ("mark", "bigint"), ("files", "bigint"), ("any_file", "boolean"), ("sized", "boolean")]
    before = one.first()
    for table in DATA.glob("*.parquet"):
        if table.name != "orders.parquet":
            (tmp_path / table.name).symlink_to(table)
    spark.read.parquet(f"{DATA}/orders.parquet").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    after = registry.QUERIES["index_fingerprint"](spark, str(tmp_path)).first()
    assert (before.files, after.files) == (1, 3)
    assert (before.books, before.mark) == (after.books, after.mark) and after.any_file and after.sized
