"""Code facts on a small workspace of three languages."""

import pytest

from tessera.operators import code

PY = '''from lib.store import Store
import os

class Cart:
    def total(self):
        return self.tax() + add(1, 2)
    def tax(self):
        return 1

def checkout(x):
    s = Store()
    s.save(x)
    add(x, 1)

@app.get("/cart/{id}")
def show(id):
    checkout(id)
'''
STORE = "class Store:\n    def save(self, x):\n        return x\n"
JS = "import { a } from './util.js'\nfunction add(x, y) {\n  return a(x)\n}\napp.post('/pay/:id', auth, pay)\n"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("shop/cart.py", PY), ("lib/store.py", STORE), ("web/add.js", JS)], "path string, text string")


def test_facts(files):
    facts = {(r.subject, r.predicate, r.object) for r in code.code_facts(files).collect()}
    assert {
        ("class:Cart", "IS_A", "Class"), ("function:Cart_total", "IS_A", "Function"), ("module:shop/cart", "DEFINES", "function:checkout"),
        ("function:Cart_total", "CALLS", "function:Cart_tax"), ("function:Cart_total", "CALLS", "function:add"), ("function:checkout", "CALLS", "function:Store_save"),
        ("module:shop/cart", "IMPORTS", "package:lib.store"), ("module:web/add", "IMPORTS", "module:web/util"), ("function:add", "CALLS", "function:a"),
        ("route:GET /cart/:param", "HANDLED_BY", "function:show"), ("route:POST /pay/:param", "HANDLED_BY", "function:pay"), ("function:show", "CALLS", "function:checkout"),
    } <= facts


def test_target_ranking(spark):
    calls = spark.createDataFrame([(1, "f", "a.py"), (2, "f", "c.py")], "site int, name string, path string")
    defs = spark.createDataFrame([("function:f", "f", "a.py"), ("function:f", "f", "b.py"), ("function:f", "f", "tests/t.py")], "subject string, name string, path string")
    imported = spark.createDataFrame([("c.py", "tests/t.py")], "from_path string, to_path string")
    assert {(r.site, r.to_path) for r in code.best_targets(calls, defs, imported).collect()} == {(1, "a.py"), (2, "tests/t.py")}


def test_architecture_and_search(spark):
    nodes = spark.createDataFrame([("n1", "route", "api/r.py", "userRoute"), ("n2", "class", "tests/t.py", "userTest"), ("n3", "function", "lib/u.py", "loadUser")], "node string, kind string, path string, label string")
    edges = spark.createDataFrame([("n1", "n3"), ("n2", "n3")], "src string, dst string")
    assert [r.node for r in code.architecture_rank(nodes, edges).collect()] == ["n1", "n3", "n2"]
    assert [r.node for r in code.search_graph(nodes, ["user"]).collect()] == ["n1", "n3", "n2"]


def test_run_diff(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "record string, position int")
    b = spark.createDataFrame([("x", 1), ("z", 2), ("w", 3)], "record string, position int")
    assert {(r.record, r.state) for r in code.run_diff(a, b).collect()} == {("x", "same"), ("y", "removed"), ("z", "moved"), ("w", "added")}
