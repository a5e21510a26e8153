"""The grammar syntax: literals, expressions, names, patterns and grammars."""

import pytest
from hypothesis import given, settings

from treegate import GrammarError, parse, sample_library
from treegate import syntax
from treegate.functions.expr import Const, Var
from treegate.functions.stdlib import Library, either, equal, negation, resolve, TABLE
from treegate.labels import BOOL, BYTES, DOUBLE, INT, STRING, UINT

from .forests import grammars


def read(rule, text):
    p = syntax.Parser(text, Library())
    out = getattr(p, f"read_{rule}")()
    assert p.at == len(text), f"{text!r} was read to {p.at}"
    return out


LITERALS = [
    ("int", "0", 0), ("int", "1", 1), ("int", "1230", 1230), ("int", "01", 1), ("int", "017", 15), ("int", "0xf", 15), ("int", "0Xff", 255), ("int", "-0xff", -255),
    ("int", "int(0114)", 76), ("int", "int(-114)", -114), ("uint", "uint(114)", 114), ("uint", "uint(025)", 21),
    ("double", "double(2.1)", 2.1), ("double", "double(2)", 2.0), ("double", "double(2E+2)", 200.0), ("double", "double(2E2)", 200.0), ("double", "double(2E-2)", 0.02), ("double", "double(2.1E-2)", 0.021), ("double", "double(-1.5)", -1.5),
    ("string", '"abc"', "abc"), ("string", r'"."', "."), ("string", r'"\U0000002E"', "."), ("string", r'"\x2E"', "."), ("string", r'"\056"', "."), ("string", r'"\t"', "\t"), ("string", r'".abc\x2E"', ".abc."), ("string", "`abc`", "abc"), ("string", '`ab"c`', 'ab"c'),
    ("bytes", "[]byte{'a'}", b"a"), ("bytes", "[]byte{'a', 'b', 'c'}", b"abc"), ("bytes", r"[]byte{'.'}", b"."), ("bytes", r"[]byte{'\x2E'}", b"."), ("bytes", r"[]byte{'\056'}", b"."), ("bytes", "[]byte{46}", b"."), ("bytes", "[]byte{ 46 }", b"."), ("bytes", "[]byte{ 46 ,    46     , 46}", b"..."),
    ("id", "abc", "abc"), ("id", "abc123", "abc123"), ("id", "abc_123", "abc_123"),
]


@pytest.mark.parametrize(("rule", "text", "want"), LITERALS)
def test_literal(rule, text, want):
    assert read(rule, text) == want


@pytest.mark.parametrize(
    ("rule", "text"),
    [("int", "09"), ("int", "01f"), ("int", "int(-114"), ("int", "int-114)"), ("uint", "uint(-12)"), ("double", "double(1/2)"), ("string", "`a`b`"), ("string", r"\/"), ("bytes", "[]byte{1000000}"), ("id", "123abc"), ("expr", "eq($bool, 1)"), ("name", "((a))"), ("string", '"open')],
)
def test_no_literal(rule, text):
    with pytest.raises((GrammarError, AssertionError)):
        read(rule, text)


@pytest.mark.parametrize("text", ["//bla\n*", "/*bla*/*", "/*bla\nbla*/*", "/*bla//bla*/*", "/* a * b */ *", "* // end\n"])
def test_comment(text):
    assert str(parse(text)) == "#main = *"


@pytest.mark.parametrize("text", ["*//bla", "*/*bla*"])
def test_open_comment(text):
    with pytest.raises(GrammarError):
        parse(text)


def _eq(kind, value):
    return resolve(TABLE, "eq", [Var(kind), Const(kind, value)])


EXPRESSIONS = [
    ("$bool", Var(BOOL)), ("$[]byte", Var(BYTES)), ("true", Const(BOOL, True)), ("== true", _eq(BOOL, True)), ('*= "a"', resolve(TABLE, "contains", [Var(STRING), Const(STRING, "a")])),
    ("not(true)", Const(BOOL, False)), ("eq($bool, true)", _eq(BOOL, True)), ("eq($int, 1)", _eq(INT, 1)), ("eq($int, length([]int{1,2}))", _eq(INT, 2)), ("== double(1)", _eq(DOUBLE, 1.0)), ("== uint(1)", _eq(UINT, 1)),
    ('~= "a"', resolve(TABLE, "regex", [Const(STRING, "a"), Var(STRING)])), (":: $int", resolve(TABLE, "type", [Var(INT)])), ('== toLower("A")', _eq(STRING, "a")),
]


@pytest.mark.parametrize(("text", "want"), EXPRESSIONS)
def test_expression(text, want):
    assert read("expr", text) == want


NAMES = [("true", _eq(BOOL, True)), ("a", _eq(STRING, "a")), ('"a"', _eq(STRING, "a")), ("!(a)", negation(_eq(STRING, "a"))), ("_", Const(BOOL, True)), ("(a|b)", either(_eq(STRING, "a"), _eq(STRING, "b"))), ("0", _eq(INT, 0)), ("uint(1)", equal(Const(UINT, 1)))]


@pytest.mark.parametrize(("text", "want"), NAMES)
def test_name(text, want):
    assert read("name", text) == want


ANY, EMPTY = ("any",), ("empty",)


def leaf(e):
    return ("node", e, EMPTY)


A = _eq(STRING, "a")
SPACES = resolve(TABLE, "regex", [Const(STRING, "^([ \t\r\n\v\f])+$"), Var(STRING)])
PATTERNS = [
    ("<empty>", EMPTY), ("*", ANY), ("(*|*)", ("or", ANY, ANY)), ("(*|*|*)", ("or", ANY, ("or", ANY, ANY))), ("(*|*|*|*|*)", ("or", ANY, ("or", ("or", ("or", ANY, ANY), ANY), ANY))),
    ("(*&*)", ("and", ANY, ANY)), ("(*&*&*)", ("and", ANY, ("and", ANY, ANY))), ("(*)*", ("star", ANY)), ("(*)?", ("optional", ANY)), ("!(*)", ("not", ANY)), ("@name", ("ref", "name")),
    ("[*,*]", ("concat", ANY, ANY)), ("[*,*,*]", ("concat", ("concat", ANY, ANY), ANY)), ("[*,*,]", ("concat", ANY, ANY)), ("{*;*}", ("interleave", ANY, ANY)), ("{*;*;*}", ("interleave", ("interleave", ANY, ANY), ANY)), ("{*;*;}", ("interleave", ANY, ANY)),
    (".*", ("contains", ANY)), ("== 1", leaf(_eq(INT, 1))), ("->eq($int, 1)", leaf(_eq(INT, 1))), ("a:*", ("node", A, ANY)), ("_:*", ("node", Const(BOOL, True), ANY)), ("_[*,*]", ("node", Const(BOOL, True), ("concat", ANY, ANY))),
    ('a:*="b"', ("node", A, leaf(resolve(TABLE, "contains", [Var(STRING), Const(STRING, "b")])))),
    ('._:*="b"', ("contains", ("node", Const(BOOL, True), leaf(resolve(TABLE, "contains", [Var(STRING), Const(STRING, "b")]))))),
    ("!(a):*", ("node", negation(A), ANY)), ("->type($string)", leaf(resolve(TABLE, "type", [Var(STRING)]))), ("<= 0", leaf(resolve(TABLE, "le", [Var(INT), Const(INT, 0)]))),
    ('a == "F"', ("node", A, leaf(_eq(STRING, "F")))), ("(* & */*spaces*/ )", ("and", ANY, ANY)), ("a :: $string", ("node", A, leaf(resolve(TABLE, "type", [Var(STRING)])))),
    ('(~="^([ \t\r\n\v\f])+$")*', ("star", leaf(SPACES))), ("(a|b):*", ("node", either(A, _eq(STRING, "b")), ANY)), ("text:*", ("node", _eq(STRING, "text"), ANY)), ("int:*", ("node", _eq(STRING, "int"), ANY)), ("user_id == 1", ("node", _eq(STRING, "user_id"), leaf(_eq(INT, 1)))),
]


@pytest.mark.parametrize(("text", "want"), PATTERNS)
def test_pattern(text, want):
    assert syntax.parse(text) == {"main": want}


def test_a_larger_pattern():
    tree = syntax.parse('Person:{Name:*;(Addr:*)?;(Email:*)*;(~="^([ \t\r\n\v\f])+$")*}')["main"]
    name, addr, email = (("node", _eq(STRING, n), ANY) for n in ("Name", "Addr", "Email"))
    assert tree == ("node", _eq(STRING, "Person"), ("interleave", ("interleave", ("interleave", name, ("optional", addr)), ("star", email)), ("star", leaf(SPACES))))


@pytest.mark.parametrize("text", ["(*|*&*)", "(*)", "()", "[*]", "[]", "{}", "{*}", "* *", "->isPrime($int)", "{ a : 1 }", "a", "->length($string)", "#main *", "", "== []int{1}", "->lt($string, \"a\")", "->elem([]int{1}, 3)", '~= "("', '~= "(?=a)"'])
def test_no_pattern(text):
    with pytest.raises(GrammarError):
        parse(text)


def test_grammars():
    assert set(syntax.parse("#main = * #a = *")) == {"main", "a"}
    assert set(syntax.parse("* #a = * #b = *")) == {"main", "a", "b"}
    assert syntax.parse("#main = * #main = <empty>")["main"] == ANY
    assert str(parse("->isPrime($int)", sample_library())) == "#main = ->isPrime($int)"


@pytest.mark.parametrize("text", ["#a = *", "@missing", "#main = @main", "#main = (@a)* #a = @main", "#main = * #a = @a", "#main = [(a:*)?, @main]", "#main = a:@missing"])
def test_rejected_grammars(text):
    with pytest.raises(GrammarError):
        parse(text)


def test_recursion_below_a_node():
    g = parse("#main = (.leaf == 1 | .next:@main)")
    assert g.compiled.is_recursive()
    assert not parse("#main = @a #a = *").compiled.is_recursive()


def test_user_functions_come_after_the_standard_library():
    library = sample_library()
    library.register("length", ["int"], "int", lambda x: x * 2)
    assert parse("->eq($int, length(4))", library).accepts([(("int", 8), [])])
    assert parse('->eq($int, length("four"))', library).accepts([(("int", 4), [])])
    with pytest.raises(GrammarError, match="doesn't take"):
        parse("->eq($int, length(true))", library)


@settings(max_examples=300, deadline=None)
@given(grammars())
def test_printed_grammars_parse_to_themselves(text):
    g = parse(text)
    again = parse(str(g))
    assert again.compiled.productions == g.compiled.productions
