"""Sums of a list are taken in the order of its lines, whatever order they arrive in."""

import duckdb
import pytest

from larder.operators import grocery as G
from larder.plans import grocery as plans

COLUMNS = "user_id long, week_start string, recipe_id long, line_no int, part_no long, supp_no long, name string, unit string, qty double, notes string, optional boolean"
#: 0.1 + 0.2 + 0.3 from the left is 0.6000000000000001, from the right 0.6.
LINES = [(1, "w", 7, n, 1, 1, "Eggs", None, q, note, False) for n, (q, note) in enumerate([(0.1, "b"), (0.2, ""), (0.3, "a"), (0.0, "b")])]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_order_of_arrival_does_not_matter(spark, order):
    (item,) = G.grocery_list(spark.createDataFrame([LINES[k] for k in order], COLUMNS).coalesce(1)).collect()
    assert (item.qty, item.notes, item.n_sources) == (0.1 + 0.2 + 0.3, "b; a", 4)
    (line,) = G.line_items(G.grocery_list(spark.createDataFrame([LINES[k] for k in order], COLUMNS).coalesce(1))).collect()
    assert line.item_qty == 0.1 + 0.2 + 0.3


def test_missing_quantity_leaves_none(spark):
    (item,) = G.grocery_list(spark.createDataFrame([*LINES, (1, "w", 8, 1, 1, 1, "Egg", None, None, None, False)], COLUMNS)).collect()
    assert (item.qty, item.notes, item.n_sources) == (None, "b; a", 5)


#: Three lines of one item: (13323 + 64251) + 93307, their order, is shown in pounds, the table's order in ounces.
ORDERS = [(93307, 6304, "1998-07-06"), (13323, 12664, "1998-07-10"), (64251, 104, "1998-07-10")]
TABLE = [(93307, 3051, 449, 3, 4.0, "R", "O"), (13323, 8631, 836, 2, 11.0, "N", "F"), (64251, 6411, 879, 3, 1.0, "A", "F")]


@pytest.mark.parametrize("files", [[3], [1, 2], [1, 1, 1]])
def test_line_items_add_up_as_the_table_lies(spark, tmp_path, files):
    db = duckdb.connect(config={"threads": 1})
    db.execute("create table orders (o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderstatus varchar default 'F', o_totalprice double default 1, o_orderpriority varchar default 'x')")
    db.executemany("insert into orders (o_orderkey, o_custkey, o_orderdate) values (?, ?, ?)", ORDERS)
    db.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    (tmp_path / "lineitem.parquet").mkdir()
    for k, n in enumerate(files):
        db.execute("create or replace table lines (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag varchar, l_linestatus varchar)")
        db.executemany("insert into lines values (?, ?, ?, ?, ?, ?, ?)", TABLE[sum(files[:k]) :][:n])
        db.execute(f"copy lines to '{tmp_path}/lineitem.parquet/{k}.parquet' (format parquet)")
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    (said,) = db.execute(plans.ORACLE_SQL["q11_line_items"]).fetchall()
    (row,) = plans.q11_line_items(spark, str(tmp_path)).collect()
    assert tuple(row) == said
    assert (row.item_qty, row.item_unit) == (4.0, "ounce")
    (item,) = plans.a1_grocery_list(spark, str(tmp_path)).collect()
    assert (item.qty, item.unit, item.notes) == (0.25, "pound", "N; A")


def test_notes_keep_the_order_of_lines(spark):
    placed = spark.createDataFrame([(*r, -n) for n, r in enumerate(LINES)], COLUMNS + ", place int")
    (item,) = G.grocery_list(placed, "place").collect()
    assert (item.qty, item.notes, item.n_sources) == (0.3 + 0.2 + 0.1, "b; a", 4)
