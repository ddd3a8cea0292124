import pytest
from pyspark.sql import functions as F

from symbolake import queries
from symbolake.functions import tables
from symbolake.operators import extract, outline
from symbolake.sources import datasource, tree


def names(source, ext):
    return [(s.split("_")[1][0], n, line) for s, n, line, _ in outline.outline(source, ext)]


def signatures(source, ext):
    return {n: s for _, n, _, s in outline.outline(source, ext)}


SCRIPT = r"""
export function greet(name) {
  return `hi ${name + `in ${ {a: 1}.a } {`} }`;
}
/* class No { */ // function no() {}
@dec
export default class Widget extends Base {
  #priv() {}
  static count = compute(1);
  constructor(a, b = {x: 1}) { super(a); function inner() {} const arrow = () => 1; }
  render() { if (x) { y() } for (const z of q(w)) {} }
  static async *gen() {}
  get size() { return { m() { return 1 }, n: 2 } }
  async load
  (x) {}
  handler = () => {}
  'quoted'() {}
  [computed]() {}
  last() {}
}
const add = (a, b) => a + b, sub = function (a) {}, k = 5
let mul = async x => x; var gen = function* () {}
const re = /[/{]function no() {/g, d = a / b / c
function* g() {}
async function f() { class Local { m() {} } }
const C = class Named { hidden() {} }
(function iife() {})()
export default function () {}
if (a) { function deep() {} } else function odd() {}
const don = <p>don't {f()}</p>
function after() {}
"""


def test_script():
    assert names(SCRIPT, ".js") == [
        ("f", "greet", 2), ("c", "Widget", 7), ("m", "Widget.constructor", 10), ("m", "Widget.inner", 10), ("m", "Widget.arrow", 10), ("m", "Widget.render", 11), ("m", "Widget.gen", 12),
        ("m", "Widget.size", 13), ("m", "Widget.m", 13), ("m", "Widget.load", 14), ("m", "Widget.last", 19), ("f", "add", 21), ("f", "sub", 21), ("f", "mul", 22), ("f", "f", 25),
        ("c", "Local", 25), ("m", "Local.m", 25), ("f", "deep", 29), ("f", "odd", 29), ("f", "after", 31),
    ]
    shown = signatures(SCRIPT, ".js")
    assert shown["greet"] == "function greet(name) {" and shown["Widget"] == "class Widget extends Base {" and shown["Widget.gen"] == "static async *gen() {}"
    assert shown["add"] == "add = (a, b) => a + b" and shown["sub"] == "sub = function (a) {}" and shown["Widget.load"] == "async load"


TYPED = """abstract class Ab { m() {} abstract n(): void; }
function over(a: string): void;
function over(a: any): { x: number } { return 1 }
const typed: (a: number) => void = (a) => {}
const gen = <T,>(x: T): Promise<{a: T}> => x
export class G<T extends {a: 1}> extends B<{b: T}> implements I<T> { private readonly x: number = 1; public go<U>(u: U): Map<string, U> { } over(): void; over() {} }
interface No { m(): void }
declare function only(a: number): void
"""


def test_typed_script():
    assert names(TYPED, ".ts") == [("f", "over", 3), ("f", "typed", 4), ("f", "gen", 5), ("c", "G", 6), ("m", "G.go", 6), ("m", "G.over", 6)]
    assert signatures(TYPED, ".tsx")["gen"] == "gen = <T,>(x: T): Promise<{a: T}> => x" and signatures(TYPED, ".ts")["G.go"].startswith("public go<U>(u: U)")


GO = """package p
type (
\tAlpha struct{}
\tBeta  struct { f func() }
\tI interface { M() }
)
type Box[T any] struct {
\tvalue T
}
type A = struct{}
type (
\tOnly struct {
\t\tx [3]int
\t}
)
func (b *Box[T]) Get() T { return b.value }
func (Box) Other(f func() int, s struct{ x int }) (a, b int) {
\ttype inner struct{}
\tx := `raw } "`
\tr := '{' // func no() {}
}
func ext(x int) int
func G[K comparable, V any](m map[K]V) map[string]interface{} {
}
func (w *Widget) Render(
\tdepth int,
) error {
}
var f = func() { }
"""


def test_go():
    assert names(GO, ".go") == [("c", "Alpha", 3), ("c", "Beta", 4), ("c", "Box", 7), ("c", "Only", 11), ("f", "Box.Get", 16), ("f", "Box.Other", 17), ("f", "ext", 22), ("f", "G", 23), ("f", "Widget.Render", 25)]
    shown = signatures(GO, ".go")
    assert shown["Alpha"] == "Alpha struct{}" and shown["Box"] == "type Box[T any] struct {" and shown["Only"] == "type (" and shown["Widget.Render"] == "func (w *Widget) Render("


RUST = """pub struct Widget<T> { value: T }
struct Unit;
pub(crate) struct Tup(u8, u8);
impl<T: Into<Vec<T>>> fmt::Display for a::Widget<T> where T: Clone {
    #[inline]
    pub(crate) async fn go<'a>(&'a self, c: char) -> Result<(), Box<dyn Error>> { let x = 'x'; let y = '{'; let s = "fn no() {}"; let r = r#"}"}"#; }
    unsafe extern "C" fn low() {}
}
mod tests {
    /* nested /* comment */ fn no() {} */
    fn works() { fn inner() {} }
    enum E { A, B { x: u8 } }
}
trait Draw { fn draw(&self); fn def(&self) {} }
macro_rules! m { () => { fn no() {} } }
impl dyn Draw { fn d() {} }
const fn c() -> u8 { 1 }
thread_local! { static X: u8 = 1; }
fn last() {}
"""


def test_rust():
    assert names(RUST, ".rs") == [("c", "Widget", 1), ("c", "Unit", 2), ("c", "Tup", 3), ("f", "Widget.go", 6), ("f", "Widget.low", 7), ("f", "works", 11), ("c", "E", 12), ("f", "def", 14), ("f", "Draw.d", 16), ("f", "c", 17), ("f", "last", 19)]
    shown = signatures(RUST, ".rs")
    assert shown["Unit"] == "struct Unit;" and shown["Tup"] == "pub(crate) struct Tup(u8, u8);" and shown["Widget.low"] == 'unsafe extern "C" fn low() {}' and shown["c"] == "const fn c() -> u8 { 1 }"


@pytest.mark.parametrize("ext", outline.EXTS)
def test_broken_files_stop_nothing(ext):
    whole = {".go": GO, ".rs": RUST}.get(ext, SCRIPT + TYPED)
    for cut in range(0, len(whole), 7):
        outline.outline(whole[:cut], ext)
        outline.outline(whole[cut:], ext)
    for odd in ("", "\0", "}" * 50, "{(" * 50, "`${`${`", "'", "func", "class", "impl", "type (", "fn", "const x =", "/*", 'r#"'):
        outline.outline(odd, ext)


def test_time_is_linear():
    """A minified file of one line, and deep nesting."""
    outline.outline("class A{m(){}}function f(){};const g=()=>1;" * 4000, ".js")
    outline.outline("function f(){" * 3000 + "}" * 3000, ".js")


FILES = "ord long, file string, ext string, content binary"


def test_outline_backend(spark):
    rows = [(0, "a.js", ".js", SCRIPT.encode()), (1, "b.go", ".go", GO.encode()), (2, "c.rs", ".rs", b"fn a() {}\xff"), (3, "d.ts", ".ts", None), (4, "e.py", ".py", b"def f(): pass")]
    got = extract.generic_symbols(spark.createDataFrame(rows, FILES), "outline").collect()
    assert {(r.file, r.language) for r in got} == {("a.js", "javascript"), ("b.go", "go")}
    assert [r.name for r in sorted(got, key=lambda r: r.ord) if r.file == "b.go"] == [n for _, n, _ in names(GO, ".go")]
    assert extract.backend(".rs", "outline") == "outline" and extract.backend(".py", "outline") == "ast"


def test_table_functions_in_sql(spark):
    tables.register(spark)
    source = "import b.c, a\nfrom . import x\nclass K:\n    def m(self): f(); f()\nf()\n"
    spark.createDataFrame([(0, "a.py", ".py", source.encode()), (1, "b.py", ".py", b"def ("), (2, "c.py", ".py", None), (3, "d.go", ".go", GO.encode())], FILES).createOrReplaceTempView("given_files")
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("SELECT f.file, s.name, s.line FROM given_files f, LATERAL python_symbols(f.content) s WHERE f.ext = '.py' ORDER BY 2") == [("a.py", "K", 3), ("a.py", "K.m", 4)]
    assert sql("SELECT s.module FROM given_files f, LATERAL python_imports(f.content) s WHERE f.ext = '.py' ORDER BY 1") == [(".x",), ("a",), ("b.c",)]
    assert sql("SELECT s.* FROM given_files f, LATERAL python_calls(f.content) s WHERE f.ext = '.py' ORDER BY 1") == [("<module>", "f", 5), ("K.m", "f", 4)]
    assert len(sql("SELECT s.* FROM given_files f, LATERAL outline_symbols(f.content, f.ext) s")) == len(names(GO, ".go"))
    assert sql("SELECT name FROM outline_symbols('fn a() {}', '.rs')") == [("a",)]


@pytest.mark.parametrize("folders", [1, 64])
def test_tree_listed_by_tasks(spark, tmp_path, folders):
    for f in ("b.py", "a/x.go", "a/_y.py", "a-b/z.rs", ".hid/h.py", "node_modules/n.js", "a/deep/er/q.ts", "a/c_pb2.py", "note.txt", "a.py/in.js"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(f.encode())
    (tmp_path / tree.IGNORE_FILE).write_text("**/*_pb2.py\n")
    key = lambda r: r.ord
    got = sorted(datasource.read_tree(spark, tmp_path, ["a-b/*"], folders).collect(), key=key)
    assert got == sorted(tree.read_tree(spark, tmp_path, ["a-b/*"]).select("ord", "file", "ext", "content", "sha256").collect(), key=key) and len(got) == 6
    (tmp_path / "empty").mkdir()
    assert datasource.read_tree(spark, tmp_path / "empty").count() == 0


@pytest.mark.parametrize("ext, text", [("py", "def f(): pass"), ("js", "function f() {}"), ("sql", "def f(): pass")])
def test_files_of_one_part_are_parsed_by_many_tasks(spark, sf, ext, text):
    """A table that comes in one part is dealt to all cores before its files are parsed."""
    if ext == "sql":
        rows = queries.python_symbols_in_sql(spark, sf)
    else:
        files = spark.range(0, 200, 1, 1).selectExpr("id ord", f"concat('f', id, '.{ext}') file", f"'.{ext}' ext", f"cast('{text}' as binary) content")
        rows = extract.symbols_of(extract.python_table(files)) if ext == "py" else extract.generic_symbols(files, "outline")
        assert rows.count() == 200
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_table_functions_get_rows_in_batches(spark):
    """Not as an Arrow table for each row."""
    tables.register(spark)
    files = spark.createDataFrame([(k, f"def f{k}(): pass") for k in range(20)], "k long, content string")
    files.createOrReplaceTempView("few_files")
    rows = spark.sql("SELECT k, s.name FROM few_files, LATERAL python_symbols(content) s")
    assert sorted(rows.collect()) == [(k, f"f{k}") for k in range(20)]
    assert "BatchEvalPythonUDTF" in rows._jdf.queryExecution().executedPlan().toString()
