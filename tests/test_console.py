import io
import sys

import pytest

from tessera import cli
from tessera.plans.join_order import EXACT_JOINS, Input, JoinNode, order_joins
from tessera.errors import SchemaError
from tessera.functions.predicates import Op
from tessera.plans.sqlparse import take_statements
from tessera.session import show
from tessera.sources.fs import Store
from tessera.sources.heap import read_heap, write_heap
from tessera.sources.sorted_table import is_sorted, write_sorted


def test_show_prints_all_rows_and_their_number(spark):
    text = show(spark.range(2500).selectExpr("id as a"))
    assert text.endswith(" 2500 rows.") and len(text.split("\n")) == 2504


def test_take_statements():
    assert take_statements("a 'x;y' b; c") == (["a 'x;y' b"], " c")
    assert take_statements("a 'x;") == ([], "a 'x;")
    assert take_statements("a 'it''s; so'; ;b;") == (["a 'it''s; so'", "b"], "")
    assert take_statements("") == ([], "")


@pytest.fixture
def schema_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1,one;two\n2,three\n")
    (tmp_path / "numbers.txt").write_text("1,2\n3,4\n")
    path = tmp_path / "catalog.txt"
    path.write_text("t (a int pk, b string)\n")
    assert cli.main(["convert", str(tmp_path / "t.txt"), str(tmp_path / "t.dat"), "int,string"]) == 0
    assert cli.main(["convert", str(tmp_path / "numbers.txt"), str(tmp_path / "numbers.dat"), "int,int"]) == 0
    return path


def test_console(schema_file, monkeypatch, capsys):
    capsys.readouterr()
    assert cli.main(["print", str(schema_file.parent / "numbers.dat"), "2"]) == 0
    assert capsys.readouterr().out.splitlines()[-4:] == ["1\t2", "3\t4", "", " 2 rows."]
    monkeypatch.setattr(sys, "stdin", io.StringIO("SELECT t.a FROM t\nWHERE t.b = 'one;two'; SELECT x FROM\n t;\nSELECT t.b FROM t WHERE t.a = 2;quit;SELECT t.a FROM t;"))
    assert cli.main(["parser", str(schema_file)]) == 0
    out = capsys.readouterr().out
    assert out.count("rows.") == 2 and "\n1\n" in out and "\nthree\n" in out and "Error" in out
    script = schema_file.parent / "q.sql"
    script.write_text("SELECT t.a FROM t WHERE t.b = 'one;two';")
    assert cli.main(["parser", str(schema_file), "-f", str(script), "-explain"]) == 0
    assert " 1 rows." in capsys.readouterr().out
    assert cli.main([]) == 1 and cli.main(["what", "x"]) == 1


def test_heap_integers_have_32_bits(spark, tmp_path):
    edge = spark.createDataFrame([(2**31 - 1,), (-(2**31),)], "a long").coalesce(1)
    assert write_heap(edge, str(tmp_path / "h")) == 2
    assert sorted(r[0] for r in read_heap(spark, str(tmp_path / "h"), edge.schema).collect()) == [-(2**31), 2**31 - 1]
    for bad in (2**31, -(2**40)):
        with pytest.raises(Exception, match="32 bits"):
            write_heap(spark.createDataFrame([(bad,)], "a long"), str(tmp_path / "bad"))


def test_heap_pages_fill_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        df = spark.range(5000).selectExpr("cast(id as int) a", "concat('s', id) b").coalesce(1)
        assert write_heap(df, str(tmp_path / "h")) == 5000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = read_heap(spark, str(tmp_path / "h"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    from tessera.sources.heap import PAGE_BYTES, slots

    assert sum(n for _, n in Store(spark, str(tmp_path / "h")).files(str(tmp_path / "h"))) == -(-5000 // slots(df.schema)) * PAGE_BYTES


def test_a_writer_that_lost_its_claim_publishes_nothing(spark, tmp_path):
    store, path = Store(spark, f"file://{tmp_path}"), f"file://{tmp_path}/1.json"
    slow = Store(spark, f"file://{tmp_path}")
    plain, fast = slow._write, []

    def write(target, text):
        plain(target, text)
        if target.getName().endswith(".tmp"):  # while the slow one writes, its claim is taken
            fast.append(store.create(path, "fast", claim_seconds=-1))

    slow._write = write
    assert slow.create(path, "slow") is False and fast == [True]
    assert store.read(path) == "fast" and not [n for n in store.names(f"file://{tmp_path}") if n.endswith(".tmp")]
    assert store.create(path, "third") is False


def test_many_joins_are_ordered_greedily():
    n = EXACT_JOINS + 11
    star = [JoinNode("fact", f"k{i}", Op.EQ, f"d{i}", "id") for i in range(n)]
    inputs = {"fact": Input(1e6, 10**6)} | {f"d{i}": Input(10.0 + i, 10 * (i + 1), "id") for i in range(n)}
    got = order_joins(star, inputs)
    assert len(got) == n and {j.right for j in got} | {j.left for j in got} == set(inputs)
    covered = {got[0].left, got[0].right}
    for j in got[1:]:
        assert j.left in covered and j.right not in covered
        covered.add(j.right)
    few = star[:6]
    exact = order_joins(few, inputs)
    import tessera.plans.join_order as module

    kept, module.EXACT_JOINS = module.EXACT_JOINS, 2
    try:
        greedy = order_joins(few, inputs)
    finally:
        module.EXACT_JOINS = kept
    assert {j.right for j in greedy} | {j.left for j in greedy} == {j.right for j in exact} | {j.left for j in exact}
    with pytest.raises(Exception, match="joining all nodes"):
        order_joins([*star, JoinNode("x", "a", Op.EQ, "y", "b")], inputs | {"x": Input(1.0, 1), "y": Input(1.0, 1)})


def test_sortedness_is_checked_inside_files(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    write_sorted(spark.range(30_000).selectExpr("id % 977 as k"), good, "k", files=3)
    assert is_sorted(spark, good, "k")
    spark.range(30_000).selectExpr("if(id = 20000, 5, id) as k").coalesce(1).write.parquet(bad)
    assert not is_sorted(spark, bad, "k")
