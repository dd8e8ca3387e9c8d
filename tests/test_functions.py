import pytest

from sheetloom.functions.colors import same_colors
from sheetloom.functions.properties import one_name, overlap, overlap_pairs
from sheetloom.functions.selectors import exclusive, ignored, likely_apart, list_key, parsed, spaced_comma, split_list, unescape, DEFAULT_IGNORED
from sheetloom.functions.tree import CssError, parse
from sheetloom.functions.values import declaration_key, one_value, same_decimals, same_units, split_top

from .cases import LISTS, PAIRS, VALUES


@pytest.mark.parametrize("prop, value, default, aggressive", VALUES)
def test_values(prop, value, default, aggressive):
    assert one_value(prop, value) == default
    assert one_value(prop, value, True) == aggressive
    assert one_value(prop, default) == default  # a spelling is its own


@pytest.mark.parametrize("text, selectors", LISTS)
def test_lists(text, selectors):
    assert split_list(text) == selectors


@pytest.mark.parametrize("a, b, exclusive_, apart", PAIRS)
def test_pairs(a, b, exclusive_, apart):
    for x, y in ((a, b), (b, a)):
        assert exclusive(x, y) == exclusive_
        assert likely_apart(x, y) == apart


def test_keys():
    assert declaration_key("Color", "RED", True) == "color: #ff0000 !important"
    assert declaration_key("word-wrap", "normal", False, True) == "overflow-wrap: normal"
    assert one_name("--Foo") == "--Foo"
    assert list_key(".b,  .a") == list_key(".a, .b")
    assert list_key('[x="a  b"]') != list_key('[x="a b"]')
    assert [spaced_comma(x) for x in (".a, .b", ".a,.b", ".a")] == [True, False, None]
    assert unescape(r"\61 b\,") == "ab," and unescape(r"\0") == "�"
    assert ignored("a::-webkit-b", DEFAULT_IGNORED) and not ignored("a::before", DEFAULT_IGNORED)
    assert not parsed("svg|rect").readable and parsed("a.b#c").classes == {"b"}


def test_exact_units():
    exact = lambda v, a=False: same_decimals(same_units(v, a))
    assert exact("1.005s") == "1005ms"
    assert exact("-0s") == "0ms" and exact("2ms") == "2ms" and exact("fade2s") == "fade2s"
    assert exact(".123456789012345678901234567891s") == "123.456789012345678901234567891ms"
    assert exact("1rad", True) == "57.29578deg" and exact("-.5turn", True) == "-180deg"
    assert same_decimals("0.50 1.0 -0.5 10.010") == ".5 1 -.5 10.01"
    assert split_top("a /* b c */ d(e f) g", " ") == ["a", "/* b c */", "d(e f)", "g"]


def test_colors():
    assert same_colors("linear-gradient(red,#ABC)".lower()) == "linear-gradient(#ff0000,#aabbcc)"
    assert same_colors("rgb(calc(1),2,3)") == "rgb(calc(1),2,3)"
    assert same_colors("rgb(50% 50% 50% / 50%)", True) == "rgba(128,128,128,0.5)"
    assert same_colors("rgb(256,0,0)") == "rgb(256,0,0)"


def test_overlap():
    assert overlap("border-top", "border-color") and overlap("margin", "margin-left")
    assert not overlap("margin-left", "margin-right") and not overlap("margin-left", "margin-inline-start")
    assert overlap("gap", "grid-gap") and overlap("all", "color") and not overlap("all", "--x")
    pairs = set(overlap_pairs())
    assert all((b, a) in pairs for a, b in pairs) and len(pairs) < 10_000


@pytest.mark.parametrize("css", [
    "a{b:c}", "a{b:c;}", "@import url(x.css);\n a { b : c ! important ; /* x */ }", "@media x{a{b:c;d:e}}\n", "/* c */a{}",
    "a{--x: { b: c; };d:e}", "a{b:url(data:image/png;base64,xx==)}", "a/* h */ b{c:d/* e */f}", "a{&:hover{c:d} e:f;}", "a{b:c};;d{e:f}",
    "a{b:c\n}", "@font-face{a:b}", "@layer a,b;", 'a{content:"}"}', "", "\n", "﻿a{b:c}",
])
def test_text_comes_back(css):
    assert parse(css).css() == css


def test_tree():
    root = parse("@media print {\n  a, b { color: red !important }\n}")
    (media,) = root.children
    (rule,) = media.children
    (decl,) = rule.children
    assert (media.name, media.text.strip(), rule.text, rule.line, rule.column) == ("media", "print", "a, b", 2, 3)
    assert (decl.name, decl.text, decl.important) == ("color", "red", True)


@pytest.mark.parametrize("css, line, column", [("a{", 1, 1), ("\na{b}", 2, 3), ("}", 1, 1), ("a{b:'c}", 1, 5), ("/*", 1, 1), ("a{b:(c}", 1, 5)])
def test_errors_have_places(css, line, column):
    with pytest.raises(CssError) as e:
        parse(css)
    assert (e.value.line, e.value.column) == (line, column)
