"""The engine's queries over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ruzi.database import Database
from ruzi.errors import EngineError
from ruzi.model import model
from ruzi.sources import store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def opened(spark: SparkSession, folder: str, *names: str) -> Database:
    """A database in memory with the folder's tables registered."""
    database = Database.memory(spark)
    for name in names or TABLES:
        database.register(name, f"{folder}/{name}.parquet")
    return database


def statement(text: str, params: dict[str, Any] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    words = text.replace(",", " ").split()
    names = [name for name in TABLES if name in words]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return opened(spark, folder, *names).query(text, params)

    return run


def rows_frame(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schema)


def copied(spark: SparkSession, folder: str, name: str) -> Database:
    database = Database.memory(spark)
    database.load("copy", spark.read.parquet(f"{folder}/{name}.parquet"))
    return database


def changed(name: str, script: str, select: str, params: dict[str, Any] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Changes to a copy of a table, then a look at it."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        database = copied(spark, folder, name)
        database.execute(script, params)
        return database.query(select)

    return run


def created(spark: SparkSession, folder: str) -> DataFrame:
    database = Database.memory(spark)
    database.execute("""
        kora itsinda t (id umubare, umutwe ijambo, byasomwe ukuri)  # declared
        kora urutonde t_id muri t (id)
        shira muri t { id: 1, umutwe: "Umuganda", byasomwe: nibyo };
        shira muri t (id, umutwe) agaciro (-2.5, 'N\\'inzira')
        shira muri t { "id": 3, byasomwe: sibyo, }
    """)
    return database.query("hitamo id, umutwe, byasomwe muri t")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """An inner transaction that fails leaves what the outer one did."""
    database = copied(spark, folder, "nation")

    def inner(tx) -> None:
        tx.delete("copy", {"n_regionkey": {"gte": 1}})
        raise ValueError

    def outer(tx) -> None:
        tx.set("copy", {"n_nationkey": 3}, {"n_name": "CHANGED"})
        try:
            tx.transaction(inner)
        except ValueError:
            tx.delete("copy", {"n_regionkey": 0})

    database.transaction(outer)
    return database.query("hitamo n_nationkey, n_name, n_regionkey muri copy")


def crud(spark: SparkSession, folder: str) -> DataFrame:
    database = opened(spark, folder, "supplier")
    return database.get_frame("supplier", {"s_acctbal": {"gte": 1000, "lt": 5000}, "s_nationkey": {"munsi_cyangwa": 12}})


def crud_limit(spark: SparkSession, folder: str) -> DataFrame:
    return opened(spark, folder, "nation").get_frame("nation", {"n_regionkey": {"gte": 1}}, 5)


def crud_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that no row has match nothing, in an object filter and in its deletions."""
    database = copied(spark, folder, "nation")
    rows = [{"kind": "known", "n": len(database.get("copy", {"n_regionkey": 2}))}, {"kind": "unknown", "n": len(database.get("copy", {"nta": 2}))}]
    try:
        database.delete("copy", {"nta": 2})
    except EngineError as error:
        rows.append({"kind": error.code, "n": len(database.get("copy"))})
    return rows_frame(spark, rows, "kind string, n long")


#: A row without the field, one with null there, and others.
PARTLY = """
    kora itsinda t
    shira muri t { id: 1 }  shira muri t { id: 2, x: ubusa }  shira muri t { id: 3, x: "c" }
    shira muri t { id: 4, x: nibyo }  shira muri t { id: 5, x: sibyo, y: ubusa }  shira muri t { id: 6, x: 0, y: nibyo }
"""


def scripted(script: str, select: str, schema: str) -> Callable[[SparkSession, str], DataFrame]:
    """A script's rows, as the row API gives them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        database = Database.memory(spark)
        database.execute(script)
        return rows_frame(spark, [{**row, "id": int(row["id"])} for row in database.query_rows(select)], schema)

    return run


def groups_of_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Groups, sums and bounds of a column whose values are of several kinds."""
    database = Database.memory(spark)
    database.execute("kora itsinda t")
    for value in (1, "1", None, -0.0, 0, [1], [1], True):
        database.add("t", {"v": value, "n": 2})
    database.add("t", {"n": 0.5})
    rows = [{"v": json.dumps(r["v"]), "n": r["bara"], "sum": float(r["teranya_n"])} for r in database.query_rows("hitamo v, bara(*), teranya(n) muri t koranya v")]
    return rows_frame(spark, rows, "v string, n long, sum double")


def dropped_all(spark: SparkSession, folder: str) -> DataFrame:
    database = copied(spark, folder, "region")
    database.execute('siba byose kora itsinda copy (a umubare) shira muri copy { a: 7, b: "after" }')
    return rows_frame(spark, [{**row, "a": float(row["a"])} for row in database.query_rows("hitamo a, b muri copy")], "a double, b string")


def left_index(spark: SparkSession, folder: str) -> DataFrame:
    """A limited join whose left table alone has an index takes its rows in the right table's order."""
    database = Database.memory(spark)
    for name in ("nation", "region"):
        database.load(name, spark.read.parquet(f"{folder}/{name}.parquet"))
    database.execute("kora urutonde n_key muri nation (n_regionkey)")
    return database.query("hitamo n_name, r_name muri nation huza region aho n_regionkey = r_regionkey imipaka 7")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """A table that was saved, changed row by row, saved again and opened."""
    place = store.shared_folder(spark)
    path = f"{place.removeprefix('file:')}/store-{uuid.uuid4().hex}"
    database = copied(spark, folder, "nation")
    database.save(path)
    database.set("copy", {"n_nationkey": 3}, {"n_name": "CHANGED", "note": "added"})
    database.delete("copy", {"n_regionkey": 0})
    database.add("copy", {"n_nationkey": 50, "n_name": "NEW"})
    return Database.open(spark, path).query("hitamo n_nationkey, n_name, n_regionkey muri copy")


def modelled(spark: SparkSession, folder: str) -> DataFrame:
    database = Database.memory(spark)
    books = model("ibitabo", {"id": "number", "umutwe": "string", "impapuro": "number", "byasomwe": "boolean"}).on(database)
    books.kora()
    for i, (title, pages, read) in enumerate((("Umuganda", 312, True), ("Inzira", 95, False), ("Urugendo", 140, None)), 1):
        books.shira({"id": i, "umutwe": title, "impapuro": pages, "byasomwe": read})
    books.hindura({"id": 2}, {"impapuro": 120.5})
    books.siba({"id": 1})
    rows = [{**row, "impapuro": float(row["impapuro"])} for row in books.hitamo({"impapuro": {"gte": 100}})]
    return rows_frame(spark, rows, "id long, umutwe string, impapuro double, byasomwe boolean")


def mixed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Loose and strict joins of columns that hold numbers and strings."""
    database = Database.memory(spark)
    database.execute("kora itsinda a kora itsinda b")
    for i, value in enumerate(("1", "1.0", 1, "x", True, None)):
        database.add("a", {"p": i, "v": value})
        database.add("b", {"q": i, "v": value})
    loose = database.query_rows("hitamo p, q muri a huza b aho a.v = b.v")
    strict = database.query_rows("hitamo p, q muri a huza b aho a.v ni b.v")
    rows = [{"kind": kind, **row} for kind, found in (("loose", loose), ("strict", strict)) for row in found]
    return rows_frame(spark, rows, "kind string, p long, q long")


#: name: (statement, parameters, SQL)
STATEMENTS: dict[str, tuple[str, dict[str, Any] | None, str]] = {
    "scan_star": ("hitamo * muri nation", None, "SELECT * FROM nation"),
    "project": ("hitamo n_name, n_regionkey, n_name muri nation", None, "SELECT n_name, n_regionkey FROM nation"),
    "filter_topk": (
        "hitamo l_orderkey, l_linenumber, l_quantity, l_extendedprice muri lineitem aho l_quantity >= 45 kandi l_discount munsi 0.05 "
        "tondeka l_extendedprice manuka, l_orderkey, l_linenumber imipaka 10",
        None,
        "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.05 "
        "ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 10",
    ),
    "filter_eq": ("hitamo * muri supplier aho s_nationkey = 7", None, "SELECT * FROM supplier WHERE s_nationkey = 7"),
    "filter_eqeq": ("hitamo s_name muri supplier aho s_nationkey == 3", None, "SELECT s_name FROM supplier WHERE s_nationkey = 3"),
    "filter_lt": ("hitamo l_orderkey, l_linenumber muri lineitem aho l_quantity < 3", None, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3"),
    "filter_lte": ("hitamo l_orderkey, l_tax muri lineitem aho l_tax <= 0.01", None, "SELECT l_orderkey, l_tax FROM lineitem WHERE l_tax <= 0.01"),
    "filter_gt": ("hitamo o_orderkey muri orders aho o_totalprice > 200000", None, "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"),
    "filter_gte": ("hitamo o_orderkey muri orders aho o_totalprice >= 150000.5", None, "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000.5"),
    "filter_ni": ("hitamo c_name muri customer aho c_nationkey ni 4", None, "SELECT c_name FROM customer WHERE c_nationkey = 4"),
    "filter_ni_string": ("hitamo c_name muri customer aho c_mktsegment ni 4", None, "SELECT c_name FROM customer WHERE false"),
    "filter_words": (
        "hitamo p_partkey muri part aho p_size hejuru 10 kandi p_size munsi_cyangwa 20 kandi p_retailprice hejuru_cyangwa 1000",
        None,
        "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 20 AND p_retailprice >= 1000",
    ),
    "filter_negative": ("hitamo c_custkey, c_acctbal muri customer aho c_acctbal < -100.25", None, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -100.25"),
    "filter_string": ('hitamo c_custkey muri customer aho c_mktsegment = "BUILDING"', None, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_loose_string": ('hitamo n_name muri nation aho n_nationkey = " 0x7 "', None, "SELECT n_name FROM nation WHERE n_nationkey = 7"),
    "filter_string_range": ("hitamo c_custkey muri customer aho c_name >= 5", None, "SELECT c_custkey FROM customer WHERE false"),
    "filter_null": ("hitamo n_name muri nation aho n_name = ubusa", None, "SELECT n_name FROM nation WHERE n_name IS NULL"),
    "filter_boolean": ("hitamo n_name muri nation aho n_nationkey = nibyo", None, "SELECT n_name FROM nation WHERE false"),
    "filter_columns": (
        "hitamo l_orderkey, l_linenumber muri lineitem aho l_discount > l_tax kandi l_linenumber = l_suppkey",
        None,
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax AND l_linenumber = l_suppkey",
    ),
    "contradiction": ("hitamo l_orderkey muri lineitem aho l_orderkey > 5 kandi l_orderkey < 3", None, "SELECT l_orderkey FROM lineitem WHERE false"),
    "param": (
        "hitamo n_nationkey muri nation aho n_name = $name kandi n_regionkey >= $least",
        {"name": "FRANCE", "least": 1},
        "SELECT n_nationkey FROM nation WHERE n_name = 'FRANCE' AND n_regionkey >= 1",
    ),
    "param_text": ("hitamo n_name muri nation aho n_name = $x", {"x": 'FRANCE" kandi n_regionkey = 1'}, "SELECT n_name FROM nation WHERE false"),
    "join_equi": ("hitamo n_name, r_name muri nation huza region aho n_regionkey = r_regionkey", None, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_star": ("hitamo * muri nation n huza region r aho n.n_regionkey = r.r_regionkey", None, "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_composite": (
        "hitamo a.l_orderkey, a.l_linenumber, b.l_quantity muri lineitem a huza lineitem b "
        "aho a.l_orderkey = b.l_orderkey kandi a.l_linenumber = b.l_linenumber kandi b.l_quantity > 49",
        None,
        "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b "
        "ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 49",
    ),
    "join_3way": (
        "hitamo l_orderkey, l_linenumber, c_name muri lineitem huza orders huza customer "
        "aho l_orderkey = o_orderkey kandi o_custkey = c_custkey kandi l_quantity >= 48",
        None,
        "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 48",
    ),
    "join_self": (
        "hitamo a.n_name, b.n_name muri nation a huza nation b aho a.n_regionkey = b.n_regionkey",
        None,
        'SELECT a.n_name AS "a.n_name", b.n_name AS "b.n_name" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey',
    ),
    "join_self_star": (
        "hitamo * muri region a huza region b aho a.r_regionkey = b.r_regionkey",
        None,
        'SELECT a.r_regionkey AS "a.r_regionkey", a.r_name AS "a.r_name", b.r_regionkey AS "b.r_regionkey", b.r_name AS "b.r_name" '
        "FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey",
    ),
    "join_theta": (
        "hitamo a.n_nationkey, b.r_regionkey muri nation a huza region b aho a.n_nationkey < b.r_regionkey",
        None,
        "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey",
    ),
    "join_cross": ("hitamo n_name, r_name muri nation huza region", None, "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "join_mixed": (
        "hitamo a.s_suppkey, b.s_name muri supplier a huza supplier b aho a.s_nationkey = b.s_nationkey kandi a.s_acctbal < b.s_acctbal",
        None,
        "SELECT a.s_suppkey, b.s_name FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    ),
    "join_ni": (
        "hitamo a.r_name, b.n_name muri region a huza nation b aho a.r_name ni b.n_name",
        None,
        "SELECT r_name, n_name FROM region JOIN nation ON r_name = n_name",
    ),
    "join_loose_kinds": ("hitamo n_name, r_regionkey muri nation huza region aho n_name = r_regionkey", None, "SELECT n_name, r_regionkey FROM nation, region WHERE false"),
    "join_topk": (
        "hitamo o_orderkey, c_name, o_totalprice muri orders huza customer aho o_custkey = c_custkey tondeka o_totalprice manuka, o_orderkey imipaka 20",
        None,
        "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    ),
    "group_count": ("hitamo event_type, bara(*) muri events koranya event_type", None, "SELECT event_type, count(*) AS bara FROM events GROUP BY 1"),
    "group_multi": (
        "hitamo l_returnflag, l_linestatus, bara(*), bara(l_tax), nto(l_quantity), nini(l_shipdate) muri lineitem koranya l_returnflag, l_linestatus",
        None,
        "SELECT l_returnflag, l_linestatus, count(*) AS bara, count(l_tax) AS bara_l_tax, min(l_quantity) AS nto_l_quantity, "
        "max(l_shipdate) AS nini_l_shipdate FROM lineitem GROUP BY 1, 2",
    ),
    "group_sum": (
        "hitamo l_linenumber, teranya(l_quantity), teranya(l_suppkey) muri lineitem koranya l_linenumber",
        None,
        "SELECT l_linenumber, sum(l_quantity) AS teranya_l_quantity, CAST(sum(l_suppkey) AS BIGINT) AS teranya_l_suppkey FROM lineitem GROUP BY 1",
    ),
    "group_distinct": ("hitamo c_mktsegment, c_nationkey muri customer koranya c_mktsegment, c_nationkey", None, "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "group_hidden_key": ("hitamo bara(*) muri customer koranya c_mktsegment", None, "SELECT count(*) AS bara FROM customer GROUP BY c_mktsegment"),
    "global_agg": (
        "hitamo bara(*), teranya(o_custkey), nto(o_orderstatus), nini(o_totalprice) muri orders",
        None,
        "SELECT count(*) AS bara, CAST(sum(o_custkey) AS BIGINT) AS teranya_o_custkey, min(o_orderstatus) AS nto_o_orderstatus, "
        "max(o_totalprice) AS nini_o_totalprice FROM orders",
    ),
    "agg_empty": (
        "hitamo bara(*), bara(o_custkey), teranya(o_custkey), nto(o_orderstatus) muri orders aho o_orderkey < 0",
        None,
        "SELECT count(*) AS bara, count(o_custkey) AS bara_o_custkey, CAST(sum(o_custkey) AS BIGINT) AS teranya_o_custkey, "
        "min(o_orderstatus) AS nto_o_orderstatus FROM orders WHERE o_orderkey < 0",
    ),
    "group_empty": ("hitamo o_orderstatus, bara(*) muri orders aho o_orderkey < 0 koranya o_orderstatus", None, "SELECT o_orderstatus, count(*) AS bara FROM orders WHERE o_orderkey < 0 GROUP BY 1"),
    "group_join": (
        "hitamo r.r_name, bara(*), nini(n.n_name) muri nation n huza region r aho n.n_regionkey = r.r_regionkey koranya r.r_name",
        None,
        "SELECT r_name, count(*) AS bara, max(n_name) AS nini_n_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "group_sort": (
        "hitamo o_orderpriority, bara(*) muri orders koranya o_orderpriority tondeka bara(*) manuka, o_orderpriority",
        None,
        "SELECT o_orderpriority, count(*) AS bara FROM orders GROUP BY 1 ORDER BY 2 DESC, 1",
    ),
    "group_topk": (
        "hitamo l_suppkey, bara(*) muri lineitem koranya l_suppkey tondeka bara(*) manuka, l_suppkey imipaka 5",
        None,
        "SELECT l_suppkey, count(*) AS bara FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    "group_sort_hidden": (
        "hitamo c_mktsegment muri customer koranya c_mktsegment tondeka nini(c_custkey) manuka imipaka 2",
        None,
        "SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY max(c_custkey) DESC LIMIT 2",
    ),
    "sort_asc": ("hitamo n_name muri nation tondeka n_name", None, "SELECT n_name FROM nation ORDER BY 1"),
    "sort_desc": ("hitamo c_custkey muri customer tondeka c_custkey manuka imipaka 25", None, "SELECT c_custkey FROM customer ORDER BY 1 DESC LIMIT 25"),
    "sort_multi": (
        "hitamo s_nationkey, s_suppkey muri supplier tondeka s_nationkey zamuka, s_suppkey manuka imipaka 30",
        None,
        "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY 1, 2 DESC LIMIT 30",
    ),
    "topk": ("hitamo event_id, value muri events tondeka value manuka, event_id imipaka 15", None, "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 15"),
    "sort_unselected": ("hitamo o_orderkey muri orders tondeka o_totalprice, o_orderkey imipaka 7", None, "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7"),
    "limit_stored_order": ("hitamo n_nationkey, n_name muri nation imipaka 4", None, "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 4"),
    "limit0": ("hitamo n_name muri nation imipaka 0", None, "SELECT n_name FROM nation LIMIT 0"),
}

_NATION = "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation"

#: name: (query, SQL)
PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ddl_create": (created, "SELECT * FROM (VALUES (1.0::DOUBLE, 'Umuganda', true), (-2.5, 'N''inzira', NULL), (3.0, NULL, false)) t(id, umutwe, byasomwe)"),
    "dml_insert": (
        changed("nation", 'shira muri copy { n_nationkey: 99, n_name: "NEW" } shira muri copy (n_nationkey, n_regionkey) agaciro (100, -1)', "hitamo n_nationkey, n_name, n_regionkey muri copy"),
        f"{_NATION} UNION ALL VALUES (99, 'NEW', NULL), (100, NULL, -1)",
    ),
    "dml_update": (
        changed("nation", 'hindura copy shyira n_name = $name, n_regionkey = ubusa aho n_nationkey = "7"', "hitamo n_nationkey, n_name, n_regionkey muri copy", {"name": "it's \"new\""}),
        f"{_NATION} WHERE n_nationkey <> 7 UNION ALL VALUES (7, 'it''s \"new\"', NULL)",
    ),
    "dml_delete": (
        changed("nation", "siba muri copy aho n_regionkey >= 2 kandi n_nationkey < 20", "hitamo n_nationkey, n_name, n_regionkey muri copy"),
        f"{_NATION} WHERE NOT (n_regionkey >= 2 AND n_nationkey < 20)",
    ),
    "ddl_index": (
        changed("region", "kora urutonde copy_key muri copy (r_regionkey) siba urutonde copy_key kora urutonde again muri copy (r_regionkey)", "hitamo r_name muri copy aho r_regionkey = 2"),
        "SELECT r_name FROM region WHERE r_regionkey = 2",
    ),
    "ddl_drop": (
        changed("region", "kora itsinda other siba itsinda copy kora itsinda copy (a umubare) shira muri copy { a: 5 }", "hitamo * muri copy"),
        "SELECT 5.0::DOUBLE AS a",
    ),
    "transactions": (transactions, f"SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM ({_NATION}) WHERE n_regionkey <> 0"),
    "null_set": (
        changed("nation", "hindura copy shyira n_regionkey = ubusa aho n_nationkey = 7", "hitamo n_name, n_regionkey muri copy aho n_regionkey = ubusa"),
        "SELECT n_name, CAST(NULL AS DOUBLE) AS n_regionkey FROM nation WHERE n_nationkey = 7",
    ),
    "null_not_missing": (scripted(PARTLY, "hitamo id muri t aho x = ubusa", "id long"), "SELECT * FROM (VALUES (2::BIGINT)) t(id)"),
    "boolean_true": (scripted(PARTLY, "hitamo id muri t aho x = nibyo", "id long"), "SELECT * FROM (VALUES (4::BIGINT)) t(id)"),
    "boolean_false": (scripted(PARTLY, "hitamo id, y muri t aho x = sibyo", "id long, y boolean"), "SELECT * FROM (VALUES (5::BIGINT, NULL::BOOLEAN)) t(id, y)"),
    "join_null_keys": (
        changed(
            "nation", "hindura copy shyira n_regionkey = ubusa aho n_nationkey = 7 hindura copy shyira n_regionkey = ubusa aho n_nationkey = 3",
            "hitamo a.n_name, b.n_nationkey muri copy a huza copy b aho a.n_regionkey = b.n_regionkey",
        ),
        "SELECT a.n_name, CAST(b.n_nationkey AS DOUBLE) AS n_nationkey FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey NOT IN (3, 7) AND b.n_nationkey NOT IN (3, 7)",
    ),
    "join_left_index": (left_index, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_regionkey, n_nationkey LIMIT 7"),
    "group_kinds": (
        groups_of_kinds,
        "SELECT * FROM (VALUES ('1', 1::BIGINT, 2.0::DOUBLE), ('\"1\"', 1, 2.0), ('null', 2, 2.5), ('0', 2, 4.0), ('[1]', 2, 4.0), ('true', 1, 2.0)) t(v, n, sum)",
    ),
    "ddl_drop_all": (dropped_all, "SELECT 7.0::DOUBLE AS a, 'after' AS b"),
    "crud_limit": (crud_limit, "SELECT * FROM nation WHERE n_regionkey >= 1 ORDER BY n_nationkey LIMIT 5"),
    "crud_unknown": (crud_unknown, "SELECT 'known' AS kind, count(*) FILTER (n_regionkey = 2) AS n FROM nation UNION ALL SELECT 'unknown', 0 UNION ALL SELECT 'E_NOT_FOUND', count(*) FROM nation"),
    "store_reopened": (
        stored,
        f"SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM ({_NATION}) WHERE n_regionkey <> 0 UNION ALL VALUES (50, 'NEW', NULL)",
    ),
    "crud_get": (crud, "SELECT * FROM supplier WHERE s_acctbal >= 1000 AND s_acctbal < 5000 AND s_nationkey <= 12"),
    "model_hitamo": (modelled, "SELECT * FROM (VALUES (2::BIGINT, 'Inzira', 120.5::DOUBLE, false), (3, 'Urugendo', 140.0, NULL)) t(id, umutwe, impapuro, byasomwe)"),
    "mixed_values": (
        mixed_values,
        "SELECT * FROM (VALUES ('loose', 0::BIGINT, 0::BIGINT), ('loose', 0, 2), ('loose', 1, 1), ('loose', 1, 2), ('loose', 2, 0), ('loose', 2, 1), "
        "('loose', 2, 2), ('loose', 3, 3), ('loose', 4, 4), ('strict', 0, 0), ('strict', 1, 1), ('strict', 2, 2), ('strict', 3, 3), ('strict', 4, 4)) t(kind, p, q)",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: statement(text, params) for name, (text, params, _) in STATEMENTS.items()},
    **{name: query for name, (query, _) in PROGRAMS.items()},
}
ORACLE_SQL: dict[str, str] = {name: sql for name, (*_, sql) in (STATEMENTS | PROGRAMS).items()}
