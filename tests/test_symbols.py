"""The lexer and the symbol index over small workspaces of several languages."""

import pytest

from tessera.functions.lexing import marks, tokens_of
from tessera.operators.symbols import SymbolIndex

PY = '''from ..lib.store import Store, load as ld
import os
# ghost()
class Cart:
    """ghost() here"""
    def __init__(self):
        self.db = Store()
    def total(self):
        text = f"ghost()"
        return self.tax() + add(1,
    2)
    def tax(self):
        self.db.save(1)
        return 'ghost(' + "\\"ghost()"

def add(a, b):
    def inner(c):
        return ld(c)
    return inner(a)

add(1, 2)
def checkout(x):
    s = Store()
    s.save(x)
'''
STORE = "class Store:\n    def save(self, x):\n        return helper(x)\n\ndef load(x):\n    return x\n\ndef _hidden():\n    pass\n"
JS = '''import d, { run as go, stop } from './util/index.js'
import * as u from "./util"
// ghost()
/* ghost( */
export const f = async (x) => { return go(`ghost() ${x}`) }
export function add(x, y) {
  const r = /ghost\\(1/.test(x) ? "ghost()" : '}';
  return u.stop(x) + d(y)
}
export default class Shop extends Base {
  constructor(db) { this.db = new Pool(); }
  async save(x) { if (x) { return this.load(x); } }
  load(x) { return add(x, 1); }
}
export { f as g }
'''
UTIL = "export function run(x) { return x }\nexport function stop() {}\nfunction main() { run(1) }\nexport default main\nexport * from '../../more'\n"
MORE = "export function extra() { return 1 }\n"
RS = '''use shop::store::Db;
/* a /* nested ghost() */ ghost() */
pub struct Store<'a> { x: &'a str }
impl<'a> Store<'a> {
    pub fn make(c: char) -> Self { let q = '"'; let r = '{'; open(c) }
    fn save(&self) { let s = r#"ghost() " }"#; self.flush(s); Store::make('x'); }
    fn flush(&self, s: &str) {}
}
fn open(c: char) {}
'''
GO = 'package a\nimport ( "fmt"\n "net/http" )\nfunc (s *Box) Save(x int) error { return fmt.Print(x) }\nfunc run() { s := `ghost() {`; Start(s) }\nfunc Start(s string) {}\n'
TEST = "def helper(x):\n    return x\n\ndef test_it():\n    helper(1)\n    add(1, 2)\n"
FILES = {"app/shop/cart.py": PY, "app/lib/store.py": STORE, "web/shop.js": JS, "web/util/index.js": UTIL, "more.js": MORE, "core/src/main.rs": RS, "srv/box.go": GO, "tests/test_help.py": TEST, "notes.txt": "def ghost(): pass"}


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([*FILES.items(), ("null.py", None)], "path string, text string")
    packages = spark.createDataFrame([("shop", "core/src/lib"), ("fmt", "x/fmt")], "name string, stem string")
    return SymbolIndex(files, packages)


def labels(index):
    return {r.id: f"{r.owner + '.' if r.owner else ''}{r.name}" for r in index.symbols.collect()}


def test_definitions_and_spans(index):
    got = {(r.path, r.kind, r.owner, r.name) for r in index.symbols.collect()}
    assert {g for g in got if g[0] == "app/shop/cart.py"} == {("app/shop/cart.py", *x) for x in [("class", None, "Cart"), ("method", "Cart", "__init__"), ("method", "Cart", "total"), ("method", "Cart", "tax"), ("function", None, "add"), ("function", None, "inner"), ("function", None, "checkout")]}
    assert {g[1:] for g in got if g[0] == "web/shop.js"} == {("function", None, "f"), ("function", None, "add"), ("class", None, "Shop"), ("method", "Shop", "constructor"), ("method", "Shop", "save"), ("method", "Shop", "load")}
    assert {g[1:] for g in got if g[0] == "core/src/main.rs"} == {("class", None, "Store"), ("method", "Store", "make"), ("method", "Store", "save"), ("method", "Store", "flush"), ("function", None, "open")}
    assert {g[1:] for g in got if g[0] == "srv/box.go"} == {("method", "Box", "Save"), ("function", None, "run"), ("function", None, "Start")}
    assert not [g for g in got if g[0] in ("notes.txt", "null.py")] and not [g for g in got if g[3] == "ghost"]
    spans = {r.name: FILES[r.path][r.start : r.stop] for r in index.symbols.collect() if r.path == "app/shop/cart.py"}
    assert spans["add"].endswith("return inner(a)") and spans["inner"].endswith("return ld(c)") and spans["checkout"].startswith("checkout(x)")
    js = {r.name: FILES[r.path][r.start : r.stop] for r in index.symbols.collect() if r.path == "web/shop.js"}
    assert js["save"] == "save(x) { if (x) { return this.load(x); } }" and js["Shop"].endswith("}\n}")


def test_nothing_inside_strings_and_comments_counts(index):
    assert index.marks.where("name = 'ghost'").count() == 0


def test_calls_and_their_targets(index):
    name = labels(index)
    got = {(r.path, name.get(r.caller, r.caller), name[r.callee], r.to_path) for r in index.calls.collect()}
    cart, store, shop, util = "app/shop/cart.py", "app/lib/store.py", "web/shop.js", "web/util/index.js"
    assert {
        (cart, "Cart.total", "Cart.tax", cart), (cart, "Cart.total", "add", cart), (cart, "Cart.tax", "Store.save", store), (cart, "inner", "load", store), (cart, "add", "inner", cart),
        (cart, "file:" + cart, "add", cart), (cart, "checkout", "Store.save", store), (cart, "checkout", "Store", store), (cart, "Cart.__init__", "Store", store),
        (shop, "f", "run", util), (shop, "add", "stop", util), (shop, "add", "main", util), (shop, "Shop.save", "Shop.load", shop), (shop, "Shop.load", "add", shop), (util, "main", "run", util),
        ("core/src/main.rs", "Store.save", "Store.flush", "core/src/main.rs"), ("core/src/main.rs", "Store.save", "Store.make", "core/src/main.rs"), ("core/src/main.rs", "Store.make", "open", "core/src/main.rs"),
        ("srv/box.go", "run", "Start", "srv/box.go"), ("tests/test_help.py", "test_it", "helper", "tests/test_help.py"),
    } <= got
    assert not [g for g in got if g[0] == store], "production code does not call what only tests define"
    assert {g[3] for g in got if g[0] == "tests/test_help.py" and g[2] == "add"} == {cart, shop}  # equally good: both


def test_imports_exports_and_packages(index):
    got = {(r.path, r.module): (r.target_path, r.target) for r in index.imports.collect()}
    assert got[("app/shop/cart.py", "..lib.store")] == ("app/lib/store.py", "module:app/lib/store")
    assert got[("app/shop/cart.py", "os")] == (None, "package:os")
    assert got[("web/shop.js", "./util/index.js")][0] == got[("web/shop.js", "./util")][0] == "web/util/index.js"
    assert got[("web/util/index.js", "../../more")] == ("more.js", "module:more")
    assert got[("core/src/main.rs", "shop::store::Db")] == (None, "module:core/src/lib") and got[("srv/box.go", "fmt")][1] == "module:x/fmt"
    offers = {(r.path, r.name) for r in index.exports.collect()}
    assert {("web/shop.js", n) for n in ("f", "g", "add", "Shop", "default")} - offers == set() and ("app/lib/store.py", "_hidden") not in offers and ("core/src/main.rs", "Store") in offers


def test_deep_relative_imports_and_stars(spark):
    files = spark.createDataFrame([
        ("a/b/c/d/e.js", "import { x } from '../../../../z/./q/../x.js'\nx()\n"), ("z/x.js", "export * from './y'\n"), ("z/y.js", "export function x() {}\n"), ("a.js", "import q from '../../out'\nexport { x as y } from './z/y'\n"),
    ], "path string, text string")
    index = SymbolIndex(files)
    got = {(r.path, r.module): (r.target_path, r.target) for r in index.imports.collect()}
    assert got[("a/b/c/d/e.js", "../../../../z/./q/../x.js")][0] == "z/x.js" and got[("a.js", "../../out")] == (None, "package:../../out")
    assert {("z/x.js", "x"), ("z/y.js", "x"), ("a.js", "y")} == {(r.path, r.name) for r in index.exports.collect()}
    assert [(r.caller, r.to_path) for r in index.calls.collect()] == [("file:a/b/c/d/e.js", "z/y.js")]


def test_graph_and_point_queries(index):
    from tessera.operators.symbols import source_graph

    nodes, edges = source_graph(index.files, index.symbols, index.imports, index.calls)
    ids = {r.id for r in nodes.collect()}
    rows = edges.collect()
    assert {r.src for r in rows} | {r.dst for r in rows} <= ids and len({r.id for r in rows}) == len(rows) and {r.kind for r in rows} == {"contains", "imports", "calls"}
    again = source_graph(index.files, index.symbols, index.imports, index.calls)[1]
    assert {r.id for r in again.collect()} == {r.id for r in rows}
    assert {r.name for r in index.callers("tax").collect()} == {"total"} and {r.name for r in index.callees("total").collect()} == {"tax", "add"}
    assert {r.path for r in index.definition("add").collect()} == {"app/shop/cart.py", "web/shop.js"}
    assert [r.name for r in index.file_outline("srv/box.go").collect()] == ["Box_Save", "run", "Start"]
    out = {r.path: (r.n_class, r.n_function, r.n_method) for r in index.repository_outline().collect()}
    assert out["app/shop/cart.py"] == (1, 3, 3) and out["notes.txt"] == (0, 0, 0)
    assert {r.path for r in index.uses("Store").collect()} >= {"app/shop/cart.py", "core/src/main.rs"}
    facts = {(r.subject, r.predicate, r.object) for r in index.facts().collect()}
    assert {("method:Cart_total", "CALLS", "method:Cart_tax"), ("class:Cart", "DEFINES", "method:Cart_tax"), ("module:web/shop", "DEFINES", "class:Shop"), ("module:web/shop", "IMPORTS", "module:web/util/index"), ("function:inner", "CALLS", "function:load")} <= facts


@pytest.mark.parametrize("text", ["", "(", ")", "}", "{{{", "'", '"', "`", "/*", "//", "def", "def f(", "class", "fn", "r#\"", "import", "export {", "export * from", "x = /", "'''", "function (", "impl", "use", "\n\n", "f(" * 50, "}" * 50 + "def f(): g()", "const x =", "func (", "é = ü()"])
@pytest.mark.parametrize("language", ["python", "javascript", "rust", "go", "java", "none"])
def test_broken_texts_do_not_crash(text, language):
    for m in marks(text, language):
        assert 0 <= m[4] <= m[5] <= len(text)


def test_tokens_cover_positions_and_lines():
    for kind, word, at, line, column in tokens_of(JS, "script"):
        assert JS[at : at + len(word)] == word and line == JS[:at].count("\n") + 1 and column == at - (JS.rfind("\n", 0, at) + 1)
