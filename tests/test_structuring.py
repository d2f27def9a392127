"""Formats and structuring."""

import re

import pytest

from emberlog.operators import structuring
from emberlog.sources.formats import LOG_FORMATS, compile_format

BRACKETS = r"<date> <time> <level> \|( \(<component>\|<process_id>\))? <message>"


@pytest.mark.parametrize("name", sorted(LOG_FORMATS))
def test_presets_compile_to_numbered_groups(name):
    fmt = compile_format(name)
    pattern = re.compile(fmt.pattern.removeprefix("(?Ud)"))
    assert "(?P<" not in fmt.pattern and max(fmt.groups) <= pattern.groups


@pytest.mark.parametrize(
    "text, trimmed, fields, pattern",
    [
        ("<name>", False, ("name",), "^(.*?)$"),
        ("<id|[a-z0-9]{1,3}>", False, ("id",), "^([a-z0-9]{1,3})$"),
        ("<key>: <value>", True, ("key", "value"), r"^\s*(.*?):\s+(.*?)\s*$"),
        (r"<object|[A-Z][a-zA-Z_]*>\((<property>=<value>\|)*\)", False, ("object", "property", "value"), r"^([A-Z][a-zA-Z_]*)\(((.*?)=(.*?)\|)*\)$"),
        (r"<optional>? <multiple>+ <integer|(\+|-)?[0-9]+><suffix>", True, ("optional", "multiple", "integer", "suffix"), r"^\s*(.*?)?\s+(.*?)+\s+((\+|-)?[0-9]+)(.*?)\s*$"),
    ],
)
def test_compiled_pattern(text, trimmed, fields, pattern):
    fmt = compile_format(text, trimmed)
    assert fmt.fields == fields and fmt.pattern == "(?Ud)" + pattern


def test_groups_count_inner_groups():
    assert compile_format(r"<integer|(\+|-)?[0-9]+><suffix>", False).groups == (1, 3)


def test_hadoop_lines(lines_of):
    rows = structuring.structure(lines_of(["2020-01-02 03:04:05,678 INFO [main worker] Client: connected to: peer 3  "]), "hadoop".replace("hadoop", LOG_FORMATS["hadoop"])).first()
    assert (rows["Date"], rows["Time"], rows["Level"], rows["Process"], rows["Component"], rows["Message"]) == ("2020-01-02", "03:04:05,678", "INFO", "main worker", "Client", "connected to: peer 3")


def test_absent_optional_group_is_null(lines_of):
    rows = structuring.structure(lines_of(["24-11   19:02 WARN  | (Net|112) error: closed", "24-11 19:27 WARN | error (peer): timeout"]), BRACKETS).orderBy("line_no").collect()
    assert [(r["component"], r["process_id"], r["message"]) for r in rows] == [("Net", "112", "error: closed"), (None, None, "error (peer): timeout")]


def test_lines_that_hold_the_seam(lines_of):
    rows = structuring.structure(lines_of(["a\u0001b: c\u0001", "x: y", "\u0001", "\u0001a\u0001b\u0001"]), "<k>: <v>", "skip").orderBy("line_no").collect()
    assert [(r["k"], r["v"]) for r in rows] == [("a\u0001b", "c\u0001"), ("x", "y")]


@pytest.mark.parametrize(("text", "groups", "optional"), [(r"(?:<a> )?<b|(x|[()]y)>(?<n>z)(<c>)?", (1, 2, 6), {"a", "c"}), (r"\(<a>\) [(<]<b>", (1, 2), set()), ("plain", (), set())])
def test_groups_and_optional_fields(text, groups, optional):
    fmt = compile_format(text)
    assert fmt.groups == groups and fmt.optional == optional


LINES = ["a: one", "b: two", "bad 1", "  bad 2 ", "bad 3", "c: three"]


def test_policies(lines_of):
    rows = lines_of(LINES)
    skipped = structuring.structure(rows, "<k>: <v>", "skip").orderBy("line_no").collect()
    assert [(r["line_no"], r["k"]) for r in skipped] == [(1, "a"), (2, "b"), (6, "c")]
    joined = structuring.structure(rows, "<k>: <v>", "append", append_to="v").orderBy("line_no").collect()
    assert [r["v"] for r in joined] == ["one", "two\nbad 1\nbad 2\nbad 3", "three"]
    assert [r["line_no"] for r in structuring.rejected(rows, "<k>: <v>").orderBy("line_no").collect()] == [3, 4, 5]
    with pytest.raises(Exception, match="line [345] doesn't fit"):
        structuring.structure(rows, "<k>: <v>").collect()
    with pytest.raises(Exception, match="line 1 doesn't fit"):
        structuring.structure(lines_of(LINES[2:]), "<k>: <v>", "append", append_to="v").collect()


def test_split_after_marker_and_non_empty(lines_of):
    rows = structuring.split_after(lines_of(["x MARK y", "z"]), ["MARK"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(1, "x MARK"), (2, " y"), (3, "z")]
    assert structuring.non_empty(lines_of(["", "q"]), "line").count() == 1


def test_empty_input_keeps_its_schema(lines_of):
    out = structuring.structure(lines_of([]), "<k>: <v>", "append", append_to="v")
    assert out.count() == 0 and {"file", "line_no", "k", "v"} <= set(out.columns)
