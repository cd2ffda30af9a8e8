import ast

import pytest

from grovework.llm import syntax as S
from grovework.llm.derivatives import Grammar

VALID = {
    "javascript": [
        "",
        "#!/usr/bin/env node\nconsole.log(1)\n",
        "import a, { b as c, default as d } from './x.js'\nimport * as ns from \"y\"\nimport 'side'\nexport { a, c as default }\nexport * from './z'\nexport * as q from './z'\n",
        "const {a, b: {c = 1}, ...rest} = obj, [x, , y = 2, ...zs] = arr\nlet f = async ({a}, [b] = [], ...c) => { await a; return b }\nvar g = x => x * 2, h = () => ({a: 1})\n",
        "class A extends (B, C) {\n  static #p = 1; x = 5\n  y\n  static { this.z = 1 }\n  constructor(a) { super(a); this.#q() }\n  get v() { return this.#p }\n  set v(n) {}\n  async *gen() { yield* other(); yield; yield 1 }\n  static async m() {}\n  #q() {}\n  ['computed' + 1]() {}\n  'str'() {}\n  get() {}\n  static() {}\n  async() {}\n}\n",
        "label: for (const [k, v] of Object.entries(o)) { if (!k) continue label; else break }\nfor (let i = 0, n = 3; i < n; i++, n--) ;\nfor (var k in o) if (k in p) delete o[k]\nfor (;;) { break }\nfor await (const x of y) {}\nfor (a.b of c) {}\nwhile (x--) y++\ndo { x } while (x) y()\n",
        "switch (a) { case 1: case 'b': f(); break; default: g() }\ntry { f() } catch { g() } finally { h() }\ntry { f() } catch ({message}) { throw new Error(`x ${`nested ${1 + 1}`} y`) }\n",
        "a = b\n(c || d).e()\nconst re = /[/\\]]+\\/(?<n>x)/giu, q = a / b / c\nif (/x/.test(y)) z = x ? /a/ : /b/\n",
        "a?.b?.[c]?.(d) ?? e\nx ||= 1; y &&= 2; z ??= 3; w **= 2 ** 3; v >>>= 1; u = a >> b >= c\nconst big = 1_000n, hex = 0xFF, oct = 0o17, f = .5e-3\n",
        "tag`a${b}c`.d`e`\nnew Foo\nnew a.b.C(1, ...args)\nnew (f())()\nimport('x').then(m => m.default)\nconst u = import.meta.url\nconst o = { a, b, 'c': 1, [d]: 2, e() {}, get f() { return 1 }, set f(v) {}, async g() {}, *h() {}, async *i() {}, ...j, async, get, new: 1, class: 2 }\n",
        "export default class {}\nexport const a = 1\nexport async function f() {}\nexport default (a, b) => a\n",
        "var of = 1, async = 2, get = 3, set = 4, from = 5, as = 6, type = 7, of2 = async\nasync(1)\nx = function* () { const y = yield }\n(async () => { await 1 })()\n!function () {}()\nvoid 0, typeof x, ~y, +z, -w\n;[1, , 2].map(f)\n",
        "return_ = 1 // comment\n/* a\n b */ x\n;({ a, b } = c)\nif (a) b\nelse c\na\n++b\n{ let x = 1 }\n",
        "const f = (a, b) =>\n  a + b\nconst s = 'it\\'s', t = \"a\\\nb\"\nx = a ? b : c ? d : e\ny = (a, b)\nz = a in b, w = a instanceof B\n",
    ],
    "typescript": [
        "import type { A } from './a'\nimport { type B, C } from './b'\nimport x = require('y')\nexport type { A }\nexport = x\n",
        "interface I<T extends object = {}> extends J<T>, K { readonly a: string; b?: number, c(x: T): void\n  [key: string]: any\n  new (x: number): I<T>\n  (y: string): void\n  get z(): number\n}\n",
        "type F = (a: number, ...b: string[]) => void\ntype G = new () => F\ntype M = { readonly [K in keyof T]?: T[K] }\ntype N = { -readonly [K in keyof T as `x${K}`]-?: T[K] }\ntype C = A extends infer U ? U : never\ntype T2 = [a: string, b?: number, ...c: boolean[]]\ntype U = | 'a' | \"b\" | 1 | -1 | null | undefined\ntype P = typeof x.y, Q = 1\n".replace("type P = typeof x.y, Q = 1\n", "type P = typeof x.y\n"),
        "function f<T, U extends keyof T>(this: Window, a: T, b?: U, c = 1): a is string { return a as unknown as string }\nfunction f(a: number): void\nfunction assert(x: unknown): asserts x is string {}\nconst g = <T,>(x: T): T => x, h = async <T>(x: T) => x!\nlet v = <any>x, w = y satisfies Z, u = f<string>(x), s = a < b, t = new Map<string, Array<number>>()\n",
        "abstract class A<T> extends B<T> implements C, D<T> {\n  private readonly x: number = 1\n  protected static y?: string\n  declare z: T\n  w!: number\n  constructor(private a: string, public readonly b = 2) { super() }\n  abstract m(): void\n  @dec() @other.x n(@param() p: number): void {}\n  override get q(): string { return '' }\n  [key: string]: any\n  foo(): void;\n  foo(x?: number): void {}\n}\n",
        "enum E { A, B = 2, 'C' = \"x\" }\nconst enum F { X }\nexport declare const d: number\ndeclare module 'm' { export function f(): void }\ndeclare global { interface Window { x: number } }\nnamespace N.M { export const a = 1 }\nexport abstract class Q {}\n",
        "@Component({ selector: 'x' })\nexport class X {}\nlet a: Array<Array<number>> = [], b: { x: number }[] = [], c: (string | number)[] = [], d: Promise<void>[]\nlet e: typeof import('x')\nconst o = { m<T>(x: T): T { return x } } as const\nfor (const x of y as any[]) {}\ntype = 1\nlet type: string, of: number\nconst f = (x: number): x is 1 => true\nlet k: unique symbol\nconst z = x! + y!.w![0]\n",
    ],
    "go": [
        "package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n\t_ \"x/y\"\n\t. \"z\"\n)\n\nconst (\n\tA = iota\n\tB\n\tC int = 1 << 3\n)\n\nvar x, y = 1, 2\nvar z map[string][]int\n\ntype T struct {\n\ta, b int `json:\"a\"`\n\t*Embedded\n\tpkg.Other\n\tf func(int) error\n}\n\ntype I interface {\n\tM(a int, b ...string) (n int, err error)\n\tfmt.Stringer\n\t~int | ~string\n}\n\ntype G[K comparable, V any] struct{ m map[K]V }\ntype Alias = T\ntype Fn func(a, b int) (int, error)\n",
        "package p\n\nfunc (t *T[K]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x == 2 {\n\t} else {\n\t\tgoto end\n\t}\n\tfor i := 0; i < 10; i++ {\n\t\tcontinue\n\t}\n\tfor k, v := range m {\n\t\t_ = k + v\n\t}\n\tfor range ch {\n\t}\n\tfor x < 3 {\n\t}\n\tfor {\n\t\tbreak\n\t}\nend:\n\tswitch y := x.(type) {\n\tcase int, *T, []string, func():\n\tdefault:\n\t\tfallthrough\n\t}\n\tswitch {\n\tcase x > 1:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\tdefault:\n\t}\n\tdefer func() { recover() }()\n\tgo f(x, y...)\n\tch <- <-other\n\tx.y.z[1:2][:3:4] = []int{1, 2, 3}[0]\n\tp := &T{a: 1, b: []map[string]int{{\"x\": 1}, {}}}\n\tvar q [3]int = [...]int{1, 2, 3}\n\ts := `raw\n\"string\"` + 'x' + '\\n'\n\tx, y = y, x\n\tx &^= 1 << 2\n\tf := func(a int) (b int) { return a }\n\tg := Max[int](1, 2)\n\th := (*T)(nil)\n\ti := interface{}(x)\n\tj := []byte(\"s\")\n\treturn\n}\n",
        "package p; func f() { if x := (T{1}); x.a == 1 {}; for _, v := range []int{1,2} { _ = v } }\nfunc g[T any, U int | string](x T) map[string]chan<- T { return nil }\nvar ch <-chan int\nvar _ = map[K]struct{}{a: {}, b: {}}\nfunc h() (func(int) int, error)\n",
    ],
    "rust": [
        "#![allow(dead_code)]\n//! doc\nuse std::{collections::{HashMap, *}, io::{self, Read as R}};\npub(crate) mod m { pub use super::*; }\nextern crate x as y;\nconst A: &'static str = \"a\\\"b\";\nstatic mut B: [u8; 3] = [0; 3];\ntype T<'a, U> = Result<Vec<&'a U>, Box<dyn Error + Send + 'static>>;\n",
        "#[derive(Debug, Clone)]\npub struct S<'a, T: Clone + 'a, const N: usize = 3> where T: Into<String> { pub a: &'a T, pub(crate) b: [u8; N], c: fn(i32) -> i32 }\nstruct U;\nstruct V(pub i32, String);\nenum E<T> { A, B(T, i32), C { x: i32 }, D = 4 }\nunion Q { a: u32 }\n",
        "impl<'a, T> Tr<T> for S<'a, T> where for<'b> &'b T: Iterator<Item = u8> {\n    type Out = Vec<T>;\n    const X: usize = 1;\n    fn new(self: Box<Self>, mut x: i32, (a, b): (i32, i32), &c: &u8) -> Option<Self::Out> { None }\n    async unsafe fn f(&mut self) -> impl Fn(i32) -> i32 + '_ { move |x| x + 1 }\n    extern \"C\" fn g();\n}\ntrait Tr<T>: Clone + ?Sized { fn a(&self); fn b(&self) -> i32 { 1 } }\nunsafe impl Send for S {}\n",
        "fn main() {\n    let x = 5u32; let (a, mut b): (i32, i32) = (1, 2);\n    let Some(y) = opt else { return };\n    let c = if x > 3 { 1 } else if let Some(z) = w { z } else { 2 };\n    'outer: for (i, v) in xs.iter().enumerate().rev() { if i == 0 { continue 'outer } break 'outer; }\n    while let Some(top) = stack.pop() {}\n    let r = loop { break 5 };\n    match v { 0 => {}, 1 | 2 => f(), 3..=5 if x > 1 => { g() } n @ 6..=9 => h(n), S { a, ref b, .. } => (), E::B(_, 1) => {} [first, .., last] => {} &(x, _) => {} -1 => {} 'a'..='z' => {} _ => unreachable!(), }\n    let v: Vec<Vec<i32>> = vec![vec![1; 3], Vec::new()];\n    println!(\"{} {:?}\", a, b);\n    let s = S { a: 1, b, ..Default::default() };\n    let t = x as u64 as f64 * 2.5e3 - 1_000.0;\n    let z = a.b.0.c::<u8>()?.await;\n    let p = &mut *q; let d = **r; let e = !f && -g < h >> 2; x += 1; x >>= 1; x <<= 2;\n    let n = x >= y; let rng = ..5; let r2 = 1..; let r3 = a..=b; for i in 0..n {}\n    let cl = |a: i32, b| -> i32 { a + b }; let c2 = || 1; let c3 = move || {};\n    let st = r#\"raw \"str\"\"#; let by = b\"bytes\\n\"; let ch = '\\'' ; let u = '\\u{1F600}'; let lt: &'static str = \"\";\n    unsafe { *ptr = 1; }\n    if x == (S { a: 1 }) {}\n    let a = <T as Tr>::f::<u8>(1); let arr = [0u8; 16]; let m = matches!(x, Some(1..=3));\n    async move { 1 }.await;\n    let f = Foo::<Vec<u8>>::new(); let t = (1,); let un = ();\n    return;\n}\n/* nested /* comment */ */\nmacro_rules! m { ($x:expr, $($y:tt)*) => { $x + 1 }; }\nlazy_static! { static ref A: i32 = 1; }\n",
    ],
}
INVALID = {
    "javascript": ["function f( {", "let x = ;", "<<<<<<< HEAD\nlet a = 1\n=======\n", "const a: number = 1", "interface A { b: string }", "fn f() {}", "def f():\n    pass\n", "a = `x ${y", "let s = 'abc\n'", "{ \"a\": 1, \"b\": 2 }", "if (a { b }", "x = 017", "class { }", "let a = <div>b</div>", "}", "with (a) b", "enum E { A }", "/* open", "package main\n"],
    "typescript": ["interface A { b: }", "function f<T(x: T) {}", "let x: = 1", "=======\nlet a = 1", "type A = ", "class A { constructor(private) } }", "fn f() -> i32 { 1 }", "const x = {", "let a = 'b", "import { a from 'b'"],
    "go": ["", "\n\n", "func f() {}", "package p\nfunc f( {}\n", "package p\nfunc f() {\n", "package p\n<<<<<<< HEAD\n", "package p\nvar x = \n", "package p\nfunc f() { if x { } else }\n", "package p\nx := 1\n", "package p\nimport fmt\n", "package p\nfunc f() { a b }\n", "package p\nvar s = \"abc\n", "def f():\n    pass\n", "package p\nfunc f() { for i := 0; i < 3 { } }\n"],
    "rust": ["fn f( {}", "fn f() {", "let x = 1;", "fn f() { let x = ; }", "=======\nfn f() {}", "struct S { a i32 }", "fn f() { match x { 1 -> 2 } }", "def f(): pass", "fn f() { \"abc }", "fn f() { x y }", "impl { }", "fn f() { a[1 }", "/* open", "fn f() { if x == S { a: 1 } {} }"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        v = S.parse(text, language)
        assert v.status == "valid", (v, text.split("\n")[(v.line or 1) - 1][:160])
        assert S.parse(text.replace("\n", "\r\n"), language).status == "valid" or "`" in text or "\\\n" in text


@pytest.mark.parametrize("language", INVALID)
def test_invalid(language):
    for text in INVALID[language]:
        assert S.parse(text, language).status != "valid", text


PYTHON = [
    "", "\n", "x = 1", "if x:\n  pass\nelif y: z\nelse:\n\tw\n", "def f(a, /, b: int = 1, *args, c, **k) -> int: return a\n", "async def f():\n    async with a as b, c: await d\n    async for x in y: yield x\n    return [i async for i in z if await i]\n",
    "@a.b(c)\n@d\nclass A(B, metaclass=C):\n    '''doc'''\n    x: int = 1\n", "try:\n    a\nexcept (A, B) as e:\n    raise X from e\nelse:\n    b\nfinally:\n    c\n", "try: a\nexcept* A: b\n", "with (open(a) as b, c as d,): pass\n", "match x:\n    case [1, *rest] if rest: a\n    case {'k': v, **kw} | A(b=1): pass\n    case _: pass\n",
    "match = 1; case = 2; type = 3; print(match, case, type)\n", "type A[T: int, *Ts, **P] = list[T]\n", "def f[T](x: T) -> T: return x\n", "lambda a, *b, c=1, **d: a if b else c\n", "x = y = [*a, *b]; x, *y = z; x[1:2, ::3, ...] += 1\n", "f'{a!r:>{w}} {b=} {{}}' 'c' 'd'\n", "{**a, 'b': 1}; {1, *c}; {k: v for k, v in d if k if v}; (x for x in y)\n", "del a.b, c[0]; assert a, b; global q; nonlocal_ = 1\n", "while (n := f()) is not None and not a in b: break\nelse: pass\n", "for x, (y, *z) in w: continue\nelse: pass\n",
    "a = b if c else d; e = not f; g = -h ** i; j = k @ l // m\n", "from . import a\nfrom ..b.c import (d as e, f,)\nfrom x import *\nimport a.b as c, d\n", "f(a, *b, c=1, **d)(e)[f].g(x for x in y)\n", "print('a'\n      'b')\nx = (1,\n     2)\n", "return 1\n", "def f():\n    yield\n    x = yield from g()\n    return *a, b\n", "# only a comment", "if 1:\n    # c\n    x\n# d\n", "x = '''<<<<<<< HEAD\n=======\n'''\n",
    # invalid
    "def f(:\n    pass\n", "if x\n    y\n", "x = (1, 2\n", "<<<<<<< HEAD\nx = 1\n", "print 'a'\n", "class A\n", "  x = 1\ny\n", "if x:\npass\n", "x = 'abc\n", "for x y in z: pass\n", "def f():\n", "fn main() {}\n", "package main\n", "import\n", "x = = 1\n", "f(a b)\n", "try:\n    a\n", "a b", "x = [1, 2", "raise from x\n", "{% if x %}\n", "=======\n", "\0", "x = 1 +\n", "return return\n", "else: pass\n", "except A, b: pass\n", "lambda: \n", "match x:\n    pass_\n", "with a as: b\n", "'''open\n", "if True:\n\tx\n        y\n",
]


def test_python_against_its_own_parser():
    for text in PYTHON:
        try:
            ast.parse(text)
            want = True
        except (SyntaxError, ValueError):
            want = False
        assert (S.parse(text, "python").status == "valid") == want, text


def test_own_sources_are_valid():
    from pathlib import Path

    for p in Path(S.__file__).resolve().parent.parent.rglob("*.py"):
        assert S.parse(p.read_text(), "python").status == "valid", p


def test_failing_token_and_truncation():
    assert S.parse("a = 1\nb = )\n", "python") == S.Verdict("error", 2, ")")
    assert S.parse("function f() {\n  g(", "javascript").status == "truncated"
    assert S.parse("fn f() {\n", "rust") == S.Verdict("truncated", 2)


def test_memo_limit_changes_nothing():
    g = Grammar("s = '(' s ')' s | ;", "s")
    for text, ok in (("(())()", True), ("(()", False), ("())", False)) * 3:
        state = g.begin()
        for c in text:
            state = g.step(state, (c,))
        assert g.complete(state) == ok
        g._reset()


def _nested(n):
    rust = lambda inside: "fn a() {" + inside + "}"
    yield "rust", "fn a() " + "{" * n + "}" * n
    yield "rust", rust("if x { " * n + "1" + "} else { 2 }" * n)
    yield "rust", rust("match x { A => " * n + "1" + ", _ => 2 }" * n)
    yield "rust", rust("match x { A => {" * n + "1" + "} _ => { 2 } }" * n)
    yield "rust", rust("x = " + "(" * n + "1" + ")" * n + ";")
    yield "go", "package a\nfunc a() " + "{" * n + "}" * n + "\n"
    for language in ("javascript", "typescript"):
        yield language, "function a() " + "{" * n + "}" * n
        yield language, "x = " + "[{a:" * n + "1" + "}]" * n + ";"
        yield language, "x = " + "(a) => (" * n + "1" + ")" * n + ";"


@pytest.mark.parametrize("depth", [8, 50, 2000])
def test_deep_nesting_keeps_small_states(depth):
    import time

    for language, text in _nested(depth):
        g = S.grammar(language)
        g._reset()
        began = time.process_time()
        assert S.parse(text, language).status == "valid", (language, text[:40])
        assert S.parse(text.rstrip(";\n")[:-1], language).status != "valid"
        assert time.process_time() - began < 2
        assert max(len(s) for s in g._state_memo.values()) <= 12
        assert len(g.kind) - g._fixed < 200 * (depth + 20)  # linear in the depth


def test_long_rust_file():
    import time

    one = "fn f%d(x: &str) -> Result<u32, E> {\n let mut v = Vec::new();\n for i in 0..10 {\n if i > 3 {\n v.push(i * 2);\n } else {\n match x {\n \"a\" => { v.clear(); }\n _ => v.push(1), } } }\n Ok(v.len() as u32)\n}\n"
    text = "".join(one % i for i in range(1000))
    began = time.process_time()
    assert S.parse(text, "rust").status == "valid" and text.count("\n") > 10_000
    assert time.process_time() - began < 2
    assert S.parse(text + "fn g() { let = 1; }\n", "rust") == S.Verdict("error", 11001, "=")


def test_whole_failing_token():
    name = "x" * 90
    assert S.parse("a = 1\n) " + name + "\n", "python").line == 2
    assert S.parse("a = b " + name + "\n", "python").token == name


FILES = "project string, file_path string, content string, indexed_at timestamp, language string, status string"


def test_frame(spark):
    from datetime import datetime as D

    rows = [
        ("p", "a.py", "x = (", D(2024, 1, 1), "clash", "clash"), ("p", "a.py", "x = 1", D(2024, 2, 1), None, None), ("p", "b.js", "let x = ;", None, None, None), ("p", "b.js", "let x = ;", None, None, None),
        ("p", "c.go", "", None, None, None), ("p", "d.rs", None, None, None, None), ("p", "e.md", "(", None, None, None), (None, "f.py", "(", None, None, None), ("p", "g.ts", "x" * 100_000 + " = [" + "1, " * 50_000 + "]", None, None, None), ("p", "H.PY", "(", None, None, None),
    ]
    f = spark.createDataFrame(rows, FILES)
    assert sorted(tuple(r) for r in S.found(f).collect()) == [("p", "H.PY"), ("p", "b.js"), ("p", "c.go")]
    rates = {(r["project"], r["language"]): r["invalid_share"] for r in S.rates(f).collect()}
    assert rates["p", "python"] == 0.5 and rates["p", "go"] == 1.0 and rates["p", "typescript"] == 0.0
    assert S.found(spark.createDataFrame([], FILES)).count() == 0
