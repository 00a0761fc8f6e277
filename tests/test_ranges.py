"""Readers of ranges against readers of whole files."""

import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.sources import archive as A
from plyforge.sources import ranges, tables

ROW = "a INT, b STRING, c STRUCT<d: ARRAY<INT>>"


@pytest.fixture
def small_ranges(spark):
    """Reads files in ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, value in before.items():
        spark.conf.set(n, value)


def strings(rng):
    parts = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "ü", "日本", "a b", "}]", "\\\"", "\u2028", ""]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))


def elements(rng, n):
    """(text, row or None) of elements, some of them malformed but balanced."""
    for i in range(n):
        row = {"a": i, "b": strings(rng), "c": {"d": [rng.randint(0, 9) for _ in range(rng.randint(0, 4))]}}
        if rng.random() < 0.1:
            row["extra"] = {"x": [[1, {"y": strings(rng)}], 2]}
        text = json.dumps(row, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1, 4]))
        if rng.random() < 0.1:
            yield rng.choice(['{"a": %d,, "b": 1}' % i, "{a: 1}", '{"a": oops}', '{"a" 1}', "tru", '{"b": "x" "y"}']), None
        else:
            yield text, row


@pytest.mark.parametrize("size", [24, 90, 4000])
@pytest.mark.parametrize("seed", [1, 2])
def test_arrays_in_ranges(spark, tmp_path, small_ranges, size, seed):
    rng = random.Random(seed)
    want, bad = [], 0
    for k in range(4):
        some = list(elements(rng, (0, 1, 12, 30)[k]))
        joint = rng.choice([",", ",\n", " ,\r\n  "])
        text = rng.choice(["", "\n\t ", "\ufeff "]) + "[" + joint.join(t for t, _ in some) + rng.choice(["]", "\n]\n", "] \r\n"])
        (tmp_path / f"f{k}.json").write_bytes(text.encode())
        want += [r for _, r in some if r]
        bad += sum(r is None for _, r in some)
    small_ranges(size)
    rows = tables.read_json_auto(spark, str(tmp_path), ROW, bad="keep")
    if size < 100:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = [r.asDict(True) for r in rows.collect()]
    assert sum(r["_corrupt_record"] is not None for r in got) == bad
    good = [r for r in got if r["_corrupt_record"] is None]
    show = lambda a, b, d: (a, b, tuple(d))
    assert Counter(show(r["a"], r["b"], r["c"]["d"]) for r in good) == Counter(show(r["a"], r["b"], r["c"]["d"]) for r in want)
    assert tables.read_json_auto(spark, str(tmp_path), ROW).count() == len(want)


def test_ends_of_arrays(spark, tmp_path, small_ranges):
    """Files that end in the middle, at a brace, or have text behind the array."""
    texts = {
        '[{"a":1},{"a":2}': ([1, 2], []), '[{"a":1},{"a":2': ([1], ['{"a":2']), '[{"a":1},{"b":{"c":"': ([1], ['{"b":{"c":"']),
        '[{"a":1},': ([1], []), '[{"a":1}]': ([1], []), '[]': ([], []), '[ ]\n': ([], []), '[{"a":1}] tail': ([1], ["tail"]),
        '[{"a":1},{"a":"x}': ([1], ['{"a":"x}']), '[{"a":1': ([], ['[{"a":1']), '[{"a":1},{"a":2}}': ([1, 2], []), "[1, 2]": ([], ["1", "2"]),
        '\ufeff[{"a":1},{"a":2}': ([1, 2], []), '\ufeff[{"a":1},{"a":2': ([1], ['{"a":2']),
        '[{"b":"never closed\n},{"a":3}]': ([3], ['{"b":"never closed\n}']),
    }
    for size in (3, 1000):
        small_ranges(size)
        for i, (text, (good, bad)) in enumerate(texts.items()):
            path = tmp_path / f"{size}-{i}.json"
            path.write_text(text)
            rows = tables.read_json_auto(spark, str(path), "a INT, b STRING", bad="keep").collect()
            assert sorted(r["a"] for r in rows if r["_corrupt_record"] is None) == good, text
            assert sorted(r["_corrupt_record"].strip() for r in rows if r["_corrupt_record"] is not None) == bad, text


def test_layouts_need_the_first_bytes_only(spark, tmp_path):
    import gzip

    (tmp_path / "lines.json").write_text("\n" * 9000 + '{"a": 1}')
    (tmp_path / "packed.json.gz").write_bytes(gzip.compress(b' [{"a": 2}, {"a": 3}]'))
    (tmp_path / "none.json").write_text(" \n")
    signs = ranges.first_signs(spark, spark.read.text(str(tmp_path)).inputFiles())
    assert sorted(signs.values()) == ["", "[", "{"]
    assert sorted(r["a"] for r in tables.read_json_auto(spark, str(tmp_path), "a INT").collect()) == [1, 2, 3]


def test_composed_states_are_those_of_the_whole_text():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice('"\\{}[],\n a') for _ in range(rng.randint(1, 60))).encode()
        # Ranges end with a brace, so a backslash at their end says nothing of the next.
        cuts = [i + 1 for i, b in enumerate(text) if b == 125 and rng.random() < 0.5 and not text[:i].endswith(b"\\")]
        whole, end = ranges.outside_strings(np.frombuffer(text, np.uint8), False)
        parts, inside = [], False
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            outside, inside = ranges.outside_strings(np.frombuffer(text[a:b], np.uint8), inside)
            parts.append(outside)
        assert inside == end and (np.concatenate(parts) == whole).all()


# --- archives ------------------------------------------------------------------------------------


def whole_games(text):
    """Games of a text read from its beginning."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    starts, inside, at = [], False, 0
    for m in re.finditer(r"[{}]|\n(?=\[Event)", text):
        if m[0] != "\n":
            inside = m[0] == "{"
        elif not inside and "\n" in text[len(text[:m.start()].rstrip(" \t\r\n\x0b\x0c")):m.start()]:
            starts.append(m.end())
    for a, b in zip([0, *starts], [*starts, len(text)]):
        game = text[a:b].strip()
        if game.startswith("[Event"):
            yield game


@pytest.mark.parametrize("size", [40, 300, 5000])
@pytest.mark.parametrize("seed", [1, 2])
def test_archives_in_ranges(spark, tmp_path, small_ranges, size, seed):
    """Mixed line ends, blank lines of several kinds, comments over many lines with games in them, and braces
    that are never closed."""
    rng = random.Random(seed)
    want = []
    for k in range(3):
        parts = []
        for i in range(20):
            note = rng.choice(["", "{a note}", '{two\n\n[Event "in a comment"]\n\nlines}', "{open ", "} shut", "{[Event \"x\"]}", "{long " + "x" * 50 + "}"])
            gap = rng.choice(["\n\n", "\n\n\n", "\n \t\n", "\n"])
            parts.append(f'[Event "{k}.{i}"]\n[EventDate "y"]\n[Site "s"]\n\n1. e4 {note} e5 1-0{gap}')
        text = rng.choice(["", "junk {x} before\n\n", "\ufeff"]) + "".join(parts)
        text = "".join(c if c != "\n" or rng.random() < (0.5, 0.0, 1.0)[k] else "\r\n" for c in text)
        (tmp_path / f"g{k}.pgn").write_bytes(text.encode())
        want += whole_games(text)
    small_ranges(size)
    got = [r["header_text"] + ("\n\n" + r["movetext"] if r["movetext"] else "") for r in A.read_games(spark, str(tmp_path)).collect()]
    plain = lambda games: Counter(re.sub(r"\s+", " ", g) for g in games)
    assert plain(got) == plain(want)
    comments = [c.strip() for text in (p.read_bytes().decode().replace("\r\n", "\n") for p in tmp_path.iterdir()) for c in re.findall(r"(?s)\{(.*?)\}", text)]
    if not any("open" in c for c in comments) and "{open" not in "".join(want):
        assert A.read_comments(spark, str(tmp_path)).count() == len([c for c in comments if c])


def test_one_game_over_many_ranges(spark, tmp_path, small_ranges):
    inner = "\n\n".join(f'[Event "quoted {i}"]' for i in range(50))
    text = f'[Event "A"]\n\n1. e4 {{{inner}}} 1-0\n\n[Event "B"]\n\n1. d4 *\n'
    (tmp_path / "a.pgn").write_text(text)
    small_ranges(40)
    rows = {r["header_text"]: r["movetext"] for r in A.read_games(spark, str(tmp_path / "a.pgn")).collect()}
    assert set(rows) == {'[Event "A"]', '[Event "B"]'} and rows['[Event "A"]'].count("quoted") == 50


def test_ranges_are_handed_over_in_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    (tmp_path / "a.pgn").write_text("\n\n".join(f'[Event "E{i}"]\n\n1. e4 {{x}} e5 1-0' for i in range(1500)))
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"a": {i}}}' for i in range(1500)) + "]")
    for read in (lambda: ranges.archive_texts(spark, str(tmp_path / "a.pgn"), F.lit("f")), lambda: ranges.array_elements(spark, [str(tmp_path / "a.json")])):
        spark.conf.set(name, "10000")
        rows = read()
        assert int(spark.conf.get(name)) <= 256 and rows.count() == 1500
