from echofold.functions import lex


def names(code, lang="js"):
    return [(f.name, f.kind) for f in lex.extract(code, lang)]


def test_masking_keeps_lines_and_hides_text():
    code = "a = 'function x(){}' // function y(){}\n/* function\nz(){} */ b = `t ${ {a:`in`} } function w(){}`; c = /fn(\\/)[/]+/g; d = e / f / g"
    masked = lex.mask(code)
    assert masked.count("\n") == code.count("\n") and "function" not in masked
    assert "e / f / g" in masked
    rust = lex.mask("/* a /* b */ fn x(){} */ let s = r#\"fn y(){}\"#; let c = '\\''; fn f<'a>(x: &'a str) {}", "rust")
    assert "fn x" not in rust and "fn y" not in rust and "fn f<'a>" in rust


def test_js_forms():
    code = """
function one(a) { return a }
const two = async (x) => x + 1;
let three = function named() { go() }
const obj = { four: () => { go() }, five(a) { go() }, onDone: () => void }
class A { six = y => y * 2; get seven() { return 1 } static async eight<T>(x: T): Promise<T> { return x } }
"""
    assert names(code) == [("one", "function"), ("two", "async-arrow"), ("three", "function-expression"), ("named", "function"), ("four", "property-arrow"), ("five", "method"), ("six", "property-arrow"), ("seven", "method"), ("eight", "method")]


def test_rust_forms():
    code = "impl T { fn a<F: Fn(u8) -> u8>(f: F) -> [f32; 3] where F: Copy { x } fn none(&self); }\nfn b() { y }"
    assert names(code, "rust") == [("a", "fn"), ("b", "fn")]


def test_tokens():
    t = lex.tokenise("a1 = 0x1f\n😀")
    assert [(x.v, x.line, x.kind) for x in t[:3]] == [("a1", 1, "id"), ("=", 1, "punct"), ("0x1f", 1, "num")]
    assert len(t) == 5 and t[-1].line == 2
    assert lex.shape(tuple(t[:3])) == ["ID", "=", "NUM"]


def test_slash_after_a_long_comment_divides():
    assert lex.mask(f"a /* {'c' * 250} */ / b / c").endswith("/ b / c")
    assert lex.mask("return /x/ + a\n / b") == "return 0 + a\n / b" and lex.mask("f = /* c */ /x/g") == "f =         0"


def test_deep_templates_and_wide_spaces():
    assert lex.mask("`${" * 3000) == "0" and lex.mask("`a${ `b${c}` + {} }` / d / e") == "0 / d / e"
    assert [t.v for t in lex.tokenise("a\u00a0b \x0b\x0cc")] == ["a", "\u00a0", "b", "c"]
