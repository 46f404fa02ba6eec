"""Query compiler, boolean grammar and settings, against worked examples."""

import pytest

from tessera.plans import grammar, settings
from tessera.plans.query import QueryError, compile_query, java_regex


@pytest.mark.parametrize(
    "query, clauses, regexes",
    [
        ("test", [[("test", "test")]], ["(test)"]),
        ("test1 test2 | test3", [[("test1", "test1"), ("test2", "test2")], [("test3", "test3")]], ["(test1.{0,32}[^a-zA-Z0-9]test2)", "(test3)"]),
        ("prefix:value", [[("prefix:value", "prefix")]], [r"(prefix\:value)"]),
        ("cat AND dog", [[("cat", "cat"), ("dog", "dog")]], ["(cat.{0,32}[^a-zA-Z0-9]dog)"]),
        ("cat OR dog", [[("cat", "cat"), ("OR", "or"), ("dog", "dog")]], ["(cat.{0,32}[^a-zA-Z0-9]OR.{0,32}[^a-zA-Z0-9]dog)"]),
        ("NOT cat", [[("NOT", "not"), ("cat", "cat")]], ["(NOT.{0,32}[^a-zA-Z0-9]cat)"]),
        ("he*l?", [[("he*l?", "he")]], ["(he.{0,24}l.?)"]),
        ("init* AND err.msg", [[("init*", "init"), ("err.msg", "err")]], [r"(init.{0,24}.{0,32}[^a-zA-Z0-9]err\.msg)"]),
        ("[abc] arr[0]", [[("arr[0]", "arr")]], [r"(arr\[0\])"]),
        ('"hello world"', [[('world"', "world")]], ['(world")']),
        ("|a| word |", [[("word", "word")]], ["(word)"]),
    ],
)
def test_compile(query, clauses, regexes):
    plan = compile_query(query)
    assert [[(t.pattern, t.prefix) for t in c.terms] for c in plan.clauses] == clauses
    assert [c.regex for c in plan.clauses] == ["(^|[^a-zA-Z0-9])" + r for r in regexes]


@pytest.mark.parametrize("query", ["", "   ", "h*ll", "a b", "foo(", "foo)", "c++", "word+{2}", "back\\1", "word{3,2}", "ab{2000}", "tail\\"])
def test_no_plan(query):
    with pytest.raises(QueryError):
        compile_query(query)


def test_braces_are_characters_unless_they_repeat():
    assert java_regex("ab{2}c{x}") == r"ab{2}c\{x\}"
    assert str(compile_query("cat dog | he*")) == "cat AND dog | he*"
    assert compile_query("Foo", True).clauses[0].java.startswith("(?d)")


@pytest.mark.parametrize(
    "query, expected",
    [
        ("hello", "hello"), ('"hello world"', '"hello world"'), ("hello*", "hello*"), ("cat AND dog", "cat AND dog"), ("cat   dog", "cat dog"), ("cat OR dog", "cat OR dog"), ("cat | dog", "cat | dog"),
        ("NOT cat", "NOT cat"), ("dog AND NOT cat", "dog AND NOT cat"), ("cat OR dog AND bird OR fish", "cat OR dog AND bird OR fish"), ("cat   and   dog", "cat and dog"), ("ORANGE", "ORANGE"),
    ],
)
def test_grammar_round_trip(query, expected):
    assert str(grammar.parse(query)) == expected


@pytest.mark.parametrize("query", ["", "AND", "cat OR", "NOT", "cat -dog", "* cat", '"open', "cat | | dog"])
def test_grammar_errors(query):
    with pytest.raises(grammar.GrammarError):
        grammar.parse(query)


def test_grammar_strict_reads_operators_inside_words():
    with pytest.raises(grammar.GrammarError):
        grammar.parse("ORANGE", strict=True)
    assert str(grammar.parse("redORANGE", strict=True)) == "redORANGE"
    assert len(grammar.parse(" AND ".join(f"t{k}" for k in range(101))).parts[0].terms) == 101


def test_settings_fall_back_to_defaults():
    s = settings.from_mapping({"server": {"max_file_size": -1, "index_workers": 999, "search": {"max_wildcard_length": 65, "max_keyword_distance": 128, "limit": {"max_results": 6000, "max_results_per_file": 7}}}, "global": {"port": 70000}, "client": {"default_limit": {"max_files_results": 5000, "max_results": 20}}})
    assert (s.max_file_size, s.port, s.max_wildcard_length, s.max_keyword_distance) == (2 * 1024 * 1024, 13134, 24, 128)
    assert s.limit == settings.Limit(5000, 7, 1000)
    assert s.client_limit == settings.Limit(20, 50, 1000)
    assert settings.checked(settings.Settings()).client_limit == settings.Limit(500, 50, 100)


def test_limits_and_filters():
    assert settings.negotiated(settings.Limit(5000, 500, 9), settings.Limit(10, 900, 1)) == settings.Limit(10, 500, 9)
    assert settings.negotiated(settings.Limit(5000, 500, 9), None) == settings.Limit(5000, 500, 9)
    general = settings.Filters(["**/*"], False, ["dist/"])
    assert settings.workspace_filters(None, False, general) == general
    assert settings.workspace_filters(settings.Filters(["*.go"]), True, general) == general
    assert settings.workspace_filters(settings.Filters([], False, []), False, general) == general
    assert settings.workspace_filters(settings.Filters([], True, []), False, general) == settings.Filters(["**/*"], True, [])


def test_settings_file(tmp_path):
    assert settings.load(str(tmp_path)) == settings.checked(settings.Settings())
    pytest.importorskip("yaml")
    (tmp_path / "config.yaml").write_text("global:\n  port: 99\nserver:\n  filters:\n    exclude:\n      customized: ['x/']\n")
    s = settings.load(str(tmp_path))
    assert s.port == 99 and s.filters.customized == ["x/"] and s.filters.include == ["**/*"]
