"""The entry point: names, columns, and the flagship whatever the partitioning (the driver compares every query)."""

import __spark_entry__
from corpusloom.plans import registry
from tests.conftest import SF


def test_names():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(registry.QUERIES) == len(set(registry.QUERIES))


def test_flagship(spark):
    df = registry.flagship(spark, SF)
    assert df.columns == ["query_id", "rank", "id", "score"] and df.count() > 0


def test_found_columns(spark):
    want = {"p1": "pair_table pair_id defect", "p2": "vec_id_a vec_id_b", "p3": "record_table id_a id_b", "p4": "item_table item_key", "p5": "record_table record_id", "p6": "ref_table record_id ref_field ref_key", "p9": "doc_id"}
    queries = __spark_entry__.queries()
    for p, columns in want.items():
        if f"{p}_found" in queries and p in ("p4", "p6"):
            assert queries[f"{p}_found"](spark, SF).columns == columns.split()


def test_results_do_not_depend_on_partitioning(spark):
    rows = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, registry.flagship(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
