"""Call sites against a machine that reads one character at a time."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.operators import callsites


def plain(source: str, nested: bool) -> str:
    """Comments blanked, by single characters; strings of one line, marks aside."""
    out, i, state, depth = [], 0, "code", 0
    while i < len(source):
        two, c = source[i : i + 2], source[i]
        show, step = c, 1
        if state == "code":
            if two == "//":
                state, show, step = "line", "  ", 2
            elif two == "/*":
                state, depth, show, step = "block", 1, "  ", 2
            elif c == '"':
                state = "text"
        elif state == "text":
            if c == "\\" and i + 1 < len(source):
                show, step = two, 2
            elif c == '"' or (c == "\n" and not nested):
                state = "code"
        elif state == "line":
            if c == "\n":
                state = "code"
            else:
                show = " "
        elif two == "*/":
            depth, show, step = depth - 1, "  ", 2
            state = "block" if depth else "code"
        elif two == "/*" and nested:
            depth, show, step = depth + 1, "  ", 2
        elif c != "\n":
            show = " "
        out.append(show)
        i += step
    return "".join(out)


PIECES = ["//", "/*", "*/", '"', "\\", "\n", "a", " fetch(", "*", "/", "é"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.booleans())
def test_comments_as_read_by_characters(source, nested):
    assert callsites.shipped(source, callsites.NESTED if nested else callsites.FLAT) == plain(source, nested)


def test_comments_nest_or_not_and_quotes_in_them_open_nothing():
    text = "/* don't /* x */ fetch(1) */ fetch(2) // \"\n`a // ${b}` + '/*' + fetch(3)"
    assert "fetch(1)" in callsites.shipped(text, callsites.FLAT) and "fetch(1)" not in callsites.shipped(text, callsites.NESTED)
    assert "fetch(3)" in callsites.shipped(text, callsites.FLAT)
    raw = 'let a = r#"// " /* "#; call(); let b: &\'a str = "}"; let c = \'{\';'
    assert callsites.shipped(raw, callsites.NESTED) == raw


def test_items_behind_a_test_mark_go():
    source = "\n".join(["call(0);", "#[cfg(test)]", "mod tests {", '    fn a() { let s = "}"; call(1); }', "}", "call(2);", "#[cfg(test)]", "use call; call(3);", 'let s = "#[cfg(test)]"; call(4);', "#[cfg(test)]", "mod open { call(5);"])
    left = callsites.shipped(source, callsites.NESTED)
    assert [f"call({i})" in left for i in range(6)] == [True, False, True, True, True, False]
    assert left.count("\n") == source.count("\n") and len(left) == len(source)


def test_sites_of_texts(spark):
    rows = [("a", "fetch(u)\n// fetch(v)\nlet x = new WebSocket('https://h.example/p?q=1'); fetch(x)", "flat"), ("b", None, "flat"), ("c", "/* fetch( */", None), ("a", "fetch(", "nested")]
    got = callsites.sites(spark.createDataFrame(rows, "path string, source string, syntax string"), ["fetch(", "WebSocket"]).collect()
    assert sorted((r.path, r.line, r.marker, tuple(r.addresses)) for r in got) == [("a", 1, "fetch(", ()), ("a", 1, "fetch(", ()), ("a", 3, "WebSocket", ("https://h.example/p?q=1",)), ("a", 3, "fetch(", ("https://h.example/p?q=1",))]


@pytest.mark.parametrize("syntax", [callsites.FLAT, callsites.NESTED])
def test_work_is_linear_in_a_text(syntax):
    callsites.shipped("/* /* */ { \" \\\" \" } fetch( ' #[cfg(test)] mod a { b(\";\"); } \n" * 20000, syntax)
