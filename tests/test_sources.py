import threading

import pytest
from pyspark.sql import functions as F

from tessera import Engine
from tessera.errors import AnalysisError, SchemaError, TransactionAborted
from tessera.functions.predicates import Op
from tessera.operators import relation
from tessera.sources.heap import convert, decode_pages, encode_pages, read_heap, read_text, slots, write_heap
from tessera.sources.snapshot import Database
from tessera.sources.sorted_table import index_scan, is_sorted, write_sorted
from tessera.types import schema_of

from .helpers import plan, rows

PAIR = schema_of([("a", "int"), ("b", "int")])
NAMED = schema_of([("k", "int"), ("s", "string")])


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, f"file://{tmp_path}/db")
    d.create("t", PAIR, "a")
    return d


def test_insert_and_scan(spark, db):
    assert rows(db.insert("t", relation(spark, [(1, 2), (3, 4)], PAIR))) == [(2,)]
    assert rows(db.insert("t", relation(spark, [], PAIR))) == [(0,)]
    assert rows(db.table("t")) == [(1, 2), (3, 4)]
    with pytest.raises(AnalysisError):
        db.insert("t", relation(spark, [(1, "x")], NAMED))
    with pytest.raises(AnalysisError):
        db.table("nope")
    with pytest.raises(SchemaError):
        db.create("t", PAIR)


def test_insert_from_itself_and_long_strings(spark, db):
    db.create("n", NAMED)
    db.insert("n", relation(spark, [(1, "x" * 300)], NAMED))
    db.insert("n", db.table("n"))
    assert rows(db.table("n")) == [(1, "x" * 128)] * 2


def test_delete(spark, db):
    db.insert("t", relation(spark, [(n, n % 3) for n in range(30)] + [(99, None)], PAIR))
    assert rows(db.delete("t", F.col("b") == 1)) == [(10,)]
    assert db.table("t").count() == 21 and rows(db.table("t").where("b is null")) == [(99, None)]
    assert rows(db.delete("t", F.col("b") == 7)) == [(0,)]
    assert rows(db.delete("t")) == [(21,)] and db.table("t").count() == 0


def test_delete_rewrites_only_files_with_matches(spark, db):
    db.insert("t", relation(spark, [(1, 1)], PAIR).coalesce(1))
    db.insert("t", relation(spark, [(2, 2)], PAIR).coalesce(1))
    before = set(db.begin().tables["t"].files)
    db.delete("t", F.col("a") == 1)
    assert set(db.begin().tables["t"].files) < before


def test_transactions(spark, db):
    one = relation(spark, [(1, 1)], PAIR)
    t = db.begin()
    db.insert("t", one, t)
    assert db.table("t").count() == 0 and db.table("t", t).count() == 1
    db.commit(t)
    assert db.table("t").count() == 1
    with pytest.raises(TransactionAborted):
        db.commit(t)
    t = db.begin()
    db.delete("t", None, t)
    db.rollback(t)
    assert db.table("t").count() == 1


def test_first_committer_wins(spark, db):
    one = relation(spark, [(1, 1)], PAIR)
    a, b = db.begin(), db.begin()
    db.insert("t", one, a)
    db.insert("t", one, b)
    db.commit(a)
    with pytest.raises(TransactionAborted):
        db.commit(b)
    assert db.table("t").count() == 1


def test_commits_to_different_tables_both_stand(spark, db):
    db.create("u", PAIR)
    one = relation(spark, [(1, 1)], PAIR)
    a, b = db.begin(), db.begin()
    db.insert("t", one, a)
    db.insert("u", one, b)
    db.commit(a)
    db.commit(b)
    assert db.table("t").count() == db.table("u").count() == 1


def test_read_modify_write_by_threads(spark, db):
    db.insert("t", relation(spark, [(0, 0)], PAIR))

    def bump():
        while True:
            t = db.begin()
            try:
                n = db.table("t", t).first()["b"]
                db.delete("t", None, t)
                db.insert("t", relation(spark, [(0, n + 1)], PAIR), t)
                db.commit(t)
                return
            except TransactionAborted:
                continue

    threads = [threading.Thread(target=bump) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert rows(db.table("t")) == [(0, 3)]


def test_a_restart_sees_committed_rows_only(spark, db):
    db.insert("t", relation(spark, [(1, 1)], PAIR))
    t = db.begin()
    db.insert("t", relation(spark, [(2, 2)], PAIR), t)  # never committed
    again = Database(spark, db.root)
    assert rows(again.table("t")) == [(1, 1)]
    assert again.vacuum() == 1 and rows(again.table("t")) == [(1, 1)]


def test_a_lost_writers_claim_is_taken_over(spark, db):
    n = db._latest() + 1
    db.store._fs.create(db.store._path(f"{db._log}/{n:012d}.json.claim")).close()
    assert not db.store.create(f"{db._log}/{n:012d}.json", "{}")
    assert db.store.create(f"{db._log}/{n:012d}.json", "{}", claim_seconds=-1)


def test_sql_statements(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.database.create("t", PAIR)
    assert rows(e.sql("INSERT INTO t VALUES (1, 2);")) == [(1,)]
    assert rows(e.sql("INSERT INTO t SELECT * FROM t")) == [(1,)]
    assert rows(e.sql("SELECT a FROM t")) == [(1,), (1,)]
    e.script("SET TRANSACTION READ WRITE; DELETE FROM t WHERE 2 > a; ROLLBACK;")
    assert rows(e.sql("SELECT COUNT(a) FROM t")) == [(2,)]
    e.script("SET TRANSACTION READ WRITE; DELETE FROM t WHERE t.a = 1 AND b < 5; INSERT INTO t VALUES (7, -7); COMMIT;")
    assert rows(e.sql("SELECT * FROM t")) == [(7, -7)]
    for bad in ("INSERT INTO t VALUES (1)", "INSERT INTO t VALUES ('a', 1)", "DELETE FROM t WHERE zz = 1", "DELETE FROM t WHERE a = b", "COMMIT"):
        with pytest.raises(AnalysisError):
            e.sql(bad)
    e.sql("SET TRANSACTION READ WRITE")
    e.sql("DELETE FROM t")
    with pytest.raises(AnalysisError):
        e.sql("INSERT INTO t VALUES (1)")
    assert e.transaction is None and rows(e.sql("SELECT a FROM t")) == [(7,)]


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("width", [1, 4])
def test_heap_pages_hold_any_number_of_rows(n, width):
    import pandas as pd

    schema = schema_of([(f"c{k}", "int") for k in range(width)])
    frame = pd.DataFrame({f"c{k}": [(i * 7 + k) % 1000 - 500 for i in range(n)] for k in range(width)}, dtype="int32")
    data = encode_pages(frame, schema)
    assert len(data) == -(-n // slots(schema)) * 4096
    assert decode_pages(data, schema).to_pandas().values.tolist() == frame.values.tolist()


def test_heap_page_layout():
    import pandas as pd

    schema = schema_of([("a", "int"), ("s", "string")])
    assert slots(schema) == 4096 * 8 // (136 * 8 + 1) == 30
    data = encode_pages(pd.DataFrame({"a": [258], "s": ["hi"]}), schema)
    assert data[0] == 1 and data[4:8] == b"\0\0\1\2" and data[8:14] == b"\0\0\0\2hi"
    with pytest.raises(SchemaError):
        decode_pages(data[:100], schema)
    with pytest.raises(SchemaError):
        encode_pages(pd.DataFrame({"a": [None], "s": ["x"]}), schema)


def test_heap_files_round_trip(spark, tmp_path):
    want = [(k, f"näme {k}") for k in range(300)]
    path = f"file://{tmp_path}/h"
    assert write_heap(relation(spark, want, NAMED).repartition(3), path) == 300
    assert rows(read_heap(spark, path, NAMED)) == sorted(want, key=repr)


def test_convert_text(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1, a\n\n 2,b \r\n3,c")
    assert convert(spark, f"{tmp_path}/in.txt", f"{tmp_path}/out", NAMED) == 3
    assert rows(read_heap(spark, f"{tmp_path}/out", NAMED)) == [(1, "a"), (2, "b"), (3, "c")]
    (tmp_path / "bad.txt").write_text("1\n")
    with pytest.raises(Exception, match="not 2 fields"):
        read_text(spark, f"{tmp_path}/bad.txt", NAMED).collect()


def test_schema_file_loads_heap_tables(spark, tmp_path):
    write_heap(relation(spark, [(1, "x")], NAMED), f"file://{tmp_path}/people.dat")
    e = Engine(spark)
    assert e.load_schema("people (k int pk, s string)", f"file://{tmp_path}") == ["people"]
    assert rows(e.sql("SELECT s FROM people WHERE k = 1")) == [("x",)]


def test_sorted_table(spark, tmp_path):
    path = f"{tmp_path}/s"
    write_sorted(relation(spark, [(v, k) for k in range(600) for v in range(5)], PAIR), path, "a", files=4)
    assert is_sorted(spark, path, "a")
    count = lambda op, v: index_scan(spark, path, "a", op, v).count()
    assert [count(Op.EQ, 3), count(Op.GE, 2), count(Op.LT, 2), count(Op.NE, 0)] == [600, 1800, 1200, 2400]
    assert [r["a"] for r in index_scan(spark, path, "a", ordered=True).collect()] == sorted([v for _ in range(600) for v in range(5)])
    assert "GreaterThan(a,3)" in plan(index_scan(spark, path, "a", Op.GT, 3))
