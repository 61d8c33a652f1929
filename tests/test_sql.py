import pytest

from tessera import Engine, show
from tessera.catalog import Catalog, parse_schema
from tessera.errors import AnalysisError, ParseError, SchemaError
from tessera.operators import relation
from tessera.plans import sqlparse as ast
from tessera.types import field_index, merge, row_bytes, same_type_vector, schema_of

from .helpers import rows

DATA = [(1, 10), (2, 20), (3, 30), (4, 40), (5, 50), (5, 50)]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("data", relation(spark, DATA, schema_of([("f1", "int"), ("f2", "int")])), "f1")
    e.register("emp", relation(spark, [(1, 1, "ann"), (2, 1, "bob"), (3, 2, "cyd")], schema_of([("id", "int"), ("dept", "int"), ("name", "string")])), "id")
    e.register("dept", relation(spark, [(1, "toys"), (2, "books"), (3, "none")], schema_of([("id", "int"), ("title", "string")])), "id")
    return e


def test_documented_single_table_select(engine):
    out = engine.sql("select d.f1, d.f2 from data d;")
    assert out.columns == ["d.f1", "d.f2"] and rows(out) == DATA


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT f1 FROM data WHERE f2 >= 40", [(4,), (5,), (5,)]),
        ("SELECT f1 FROM data WHERE 40 <= f2", [(4,), (5,), (5,)]),
        ("SELECT f1 FROM data WHERE f2 <> 50 AND f1 > 2", [(3,), (4,)]),
        ("SELECT f1 FROM data WHERE f2 != 50 AND 2 < f1", [(3,), (4,)]),
        ("SELECT SUM(f2) FROM data", [(200,)]),
        ("SELECT COUNT(*) FROM data", [(6,)]),
        ("SELECT f1, count(f2) FROM data GROUP BY f1", [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]),
        ("SELECT count(f2), f1 FROM data GROUP BY f1", [(1, 1), (1, 2), (1, 3), (1, 4), (2, 5)]),
        ("SELECT e.name, d.title FROM emp e, dept d WHERE e.dept = d.id", [("ann", "toys"), ("bob", "toys"), ("cyd", "books")]),
        ("SELECT name FROM emp WHERE name LIKE 'n'", [("ann",)]),
        ("SELECT name FROM emp WHERE name ~ 'b'", [("bob",)]),
        ("SELECT a.name, b.name FROM emp a, emp b WHERE a.id < b.id AND a.dept = b.dept", [("ann", "bob")]),
        ("SELECT f1 FROM data WHERE f2 = (SELECT MAX(x.f2) FROM data x)", [(5,), (5,)]),
        ("SELECT f1 FROM data WHERE (SELECT MIN(x.f2) FROM data x) = f2", [(1,)]),
        ("SELECT name FROM emp WHERE emp.id = (SELECT d.f1 FROM data d WHERE d.f1 > 2)", [("cyd",)]),
        ("SELECT title FROM dept WHERE title = 'it''s'", []),
    ],
)
def test_selects(engine, text, want):
    assert rows(engine.sql(text)) == want


def test_star_is_in_from_order_whatever_the_join_order(engine):
    engine.analyze()
    out = engine.sql("SELECT * FROM emp e, dept d WHERE e.dept = d.id")
    assert out.columns == ["e.id", "e.dept", "e.name", "d.id", "d.title"]
    for mode in ("none", "selinger"):
        engine.reorder = mode
        assert rows(engine.sql("SELECT * FROM emp e, dept d WHERE e.dept = d.id")) == rows(out)


def test_order_by_an_unselected_column(engine):
    assert [r[0] for r in engine.sql("SELECT name FROM emp ORDER BY id DESC").collect()] == ["cyd", "bob", "ann"]
    assert [r[0] for r in engine.sql("SELECT dept, COUNT(id) FROM emp GROUP BY dept ORDER BY dept").collect()] == [1, 2]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT f1 FROM data WHERE f1 = 1 OR f1 = 2", "SELECT f1 FROM data WHERE NOT f1 = 1", "SELECT f1 + 1 FROM data",
        "SELECT DISTINCT f1 FROM data", "SELECT f1 FROM data LIMIT 3", "SELECT f1, COUNT(f2) FROM data GROUP BY f1 HAVING f1 > 1",
        "SELECT f1 FROM data UNION SELECT f1 FROM data", "SELECT f1 FROM data ORDER BY f1, f2", "SELECT f1 FROM data GROUP BY f1",
        "SELECT SUM(f1), MAX(f1) FROM data", "SELECT f2, SUM(f1) FROM data", "SELECT f2, SUM(f1) FROM data GROUP BY f1",
        "UPDATE data SET f1 = 1", "SELECT f1 FROM data WHERE 1 = 1", "SELECT SUM(*) FROM data", "SELECT f1 AS x FROM data", "SELECT",
        "SELECT f1 FROM data d, emp d", "SELECT f1 FROM data WHERE f1 IN (1, 2)", "SELECT f1 FROM data WHERE f1 = 1.5",
    ],
)
def test_what_the_dialect_refuses(engine, text):
    with pytest.raises(ParseError):
        engine.sql(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT id FROM emp, dept WHERE emp.dept = dept.id", "SELECT f1 FROM nothing", "SELECT zz FROM data", "SELECT x.f1 FROM data",
        "SELECT f1 FROM data, emp", "SELECT emp.id FROM emp, dept, data WHERE emp.dept = dept.id", "SELECT f1 FROM data WHERE f1 = f2",
        "SELECT f1 FROM data WHERE f1 = 'a'", "SELECT MAX(name) FROM emp", "SELECT dept, COUNT(id) FROM emp GROUP BY dept ORDER BY name",
    ],
)
def test_what_analysis_refuses(engine, text):
    with pytest.raises(AnalysisError):
        engine.sql(text).collect()


def test_cyclic_joins_keep_every_condition(engine, spark):
    for n in "xyz":
        engine.register(n, relation(spark, [(1, 1), (2, 5), (3, 3)], schema_of([("k", "int"), ("v", "int")])))
    engine.register("y", relation(spark, [(1, 1), (2, 6), (3, 3)], schema_of([("k", "int"), ("v", "int")])))
    out = engine.sql("SELECT x.k FROM x, y, z WHERE x.k = y.k AND y.k = z.k AND x.v = y.v AND z.v = x.v")
    assert rows(out) == [(1,), (3,)]


def test_explain_shows_the_tree(engine):
    engine.analyze()
    text = engine.explain("SELECT e.name FROM emp e, dept d WHERE e.dept = d.id AND d.title = 'toys' ORDER BY e.name")
    assert "⨝(" in text and "σ(" in text and "scan(emp e)" in text and text.startswith("π(") and "card:" in text


def test_show_prints_rows(engine):
    assert show(engine.sql("SELECT f1 FROM data WHERE f1 = 1")).splitlines()[0] == "data.f1"


def test_script_splits_outside_strings():
    assert ast.split_statements("SELECT a FROM b WHERE c = 'x;y'; COMMIT;") == ["SELECT a FROM b WHERE c = 'x;y'", "COMMIT"]
    with pytest.raises(ParseError):
        ast.split_statements("SELECT a FROM b")


def test_schema_text():
    specs = parse_schema("emp (id int pk, name string)\n\ndept(id INT)\n")
    assert [(s.name, s.primary_key, s.schema.names) for s in specs] == [("emp", "id", ["id", "name"]), ("dept", None, ["id"])]
    for bad in ("emp", "emp (id)", "emp (id float)", "emp (id int key)"):
        with pytest.raises(SchemaError):
            parse_schema(bad)


def test_catalog_latest_wins_and_unknown_names(spark):
    c = Catalog()
    a, b = (relation(spark, [(n,)], schema_of([("x", "int")])) for n in (1, 2))
    c.register("t", a)
    c.register("t", b, "x")
    assert rows(c.table("t")) == [(2,)] and c.spec("t").primary_key == "x"
    for name in (None, "nope"):
        with pytest.raises(AnalysisError):
            c.table(name)


def test_schemas():
    a, b = schema_of([("x", "int"), ("y", "string")]), schema_of([("p", "int"), ("q", "string")])
    assert same_type_vector(a, b) and not same_type_vector(a, schema_of([("x", "int")]))
    assert merge(a, b).names == ["x", "y", "p", "q"] and field_index(merge(a, a), "y") == 1 and row_bytes(a) == 4 + 132
    with pytest.raises(AnalysisError):
        field_index(a, "Y")
