"""JSON arrays in byte ranges, against json.loads of the whole, cut at every byte."""

import json
import random

import pytest

from threadloom.operators import forest
from threadloom.sources import arrays, tables

HARD = r'''[ {"a": "x\\", "b": "{[\"", "é": "😀A"}, // note "quoted, { not closed
 {"c": [{"d": {}}, {"e": "/* no */ // no"}]}, /* block " { ** / */ {"f": "\\\\\""},/**/{"g":1},
 {"h": "a,}", }, /***/ {"i": "\\"} ]'''


def whole(text):
    return json.loads(tables.lenient(text)) or []


def by_ranges(data, size):
    state, depth, out = arrays.PLAIN, 0, []
    for start in range(0, len(data), size):
        part = data[start : start + size]
        end, change, opened = arrays.summary(part)[state]
        found = list(arrays.objects(lambda a, b: data[a:b], start, min(start + size, len(data)), state, depth))
        assert len(found) == sum(n for d, n in opened.items() if d + depth == 1)
        out += [json.loads(tables.lenient(x.decode())) for x in found]
        state, depth = end, depth + change
    assert depth == 0
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 16, 50, 1000])
def test_cuts(size):
    """Cuts inside strings, escapes, comments, their marks, and characters of several bytes."""
    assert by_ranges(HARD.encode(), size) == whole(HARD) and by_ranges(b"null", size) == [] and by_ranges(b"\xef\xbb\xbf[]", size) == []


def test_random_cuts():
    rng = random.Random(4)
    pieces = ['"', "\\", "/", "*", "{", "}", "[", "]", ",", "é", "\n", "//", "/*", "*/", " "]
    for _ in range(150):
        rows = [{"".join(rng.choice("abc") for _ in range(2)): "".join(rng.choice(pieces) for _ in range(rng.randrange(12))), "n": [{"m": {}}] * rng.randrange(3)} for _ in range(rng.randrange(6))]
        notes = [rng.choice(["", " ", "/* { \" ** */", "// } \"\n", "/**/"]) for _ in range(len(rows) + 1)]
        text = "[" + notes[0] + ",".join(json.dumps(r, ensure_ascii=False) + n for r, n in zip(rows, notes[1:])) + "]"
        assert by_ranges(text.encode(), rng.randrange(1, 30)) == rows


def test_many_tasks(spark, tmp_path):
    """Two files whose conversations interleave: one number over both, whatever the ranges are; the first row of the input gives titles."""
    node = lambda i: {"ConversationId": f"c{i % 5}", "NodeId": f"n{i}", "Title": f"t{i}", "Text": 'a "quoted" {text}\n' * (i % 7), "CreateTime": 1.0, "Role": "user"}
    for name, part in (("b.json", range(300, 500)), ("a.json", range(300))):
        (tmp_path / name).write_text(json.dumps([node(i) for i in part], indent=1))
    (tmp_path / "c.json").write_text("null")
    for size in (700, 1 << 20):
        df = tables.flat_json(spark, f"{tmp_path}/*.json", size)
        got = df.orderBy("row_idx").select("row_idx", "node_id", "text", "title").collect()
        assert [tuple(r) for r in got] == [(i, f"n{i}", node(i)["Text"], f"t{i}") for i in range(500)]
    assert {r.conversation_id: r.title for r in forest.attributes(df).collect()} == {f"c{i}": f"t{i}" for i in range(5)}
    # All leaves have one time: the first of the input is the current path.
    assert {r.node_id for r in forest.current_path(df.where("row_idx >= 250")).collect()} == {f"n{i}" for i in range(250, 255)}
