"""Large JSON files by ranges against Python's parser on whole files."""

import json
import random

import pytest

from corpusloom.sources import files, json_split


def some_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return "".join(rng.choice(['a', ',', '"', '\\', '[', ']', '{', '}', 'é', '\n', ' ', '漢', ':']) for _ in range(rng.randrange(0, 25)))
    if kind < 6:
        return rng.choice([0, -12.5, 10**12, True, False, None, "", "\\\\", '\\"'])
    if kind < 8:
        return {some_value(rng, 9) if rng.random() < 0.1 else f"k{i}": some_value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [some_value(rng, depth + 1) for _ in range(rng.randrange(5))]


@pytest.fixture
def split_bytes(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "30")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def layouts(rng):
    """Some files' texts with the values that they hold."""
    many = [some_value(rng) for _ in range(60)]
    boxes = [v for v in many if isinstance(v, (dict, list, str))]
    yield "array", json.dumps(many), many
    yield "pretty", "\ufeff \n" + json.dumps(many, indent=2, ensure_ascii=False) + " \n", many
    yield "commas", "[," + " ,, ".join(json.dumps(v) for v in many) + ",]  what follows [1, 2", many
    yield "lines", "\n".join(json.dumps(v) for v in many[-1:] * 0 + [{"a": 1}] + many) + "\n", [{"a": 1}, *many]
    yield "stuck", json.dumps({"first": 1}) + "".join(json.dumps(v, ensure_ascii=False) for v in boxes if not isinstance(v, str)) + "true 12", [{"first": 1}, *[v for v in boxes if not isinstance(v, str)], True, 12]
    yield "strings", '"x"' + "".join(json.dumps(v) for v in boxes if isinstance(v, str)), ["x", *[v for v in boxes if isinstance(v, str)]]
    yield "long", json.dumps([{"t": "x, y " * 700}, 5, {"u": ["[{" * 400, 7]}]), [{"t": "x, y " * 700}, 5, {"u": ["[{" * 400, 7]}]
    yield "scalars", "1 2\n3 null true", [1, 2, 3, None, True]
    yield "none", " \n ", []
    yield "void", "", []
    yield "bare", "[]", []


@pytest.mark.parametrize("split_bytes", ["61", "170", "1000", "128m"], indirect=True)
@pytest.mark.parametrize("sent", [json_split._SENT, 0])
def test_values_are_the_same_for_any_ranges(spark, tmp_path, split_bytes, sent):
    rng = random.Random(7)
    want = {}
    for name, text, values in layouts(rng):
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        want[name] = values
    rows = json_split.split_values(spark, str(tmp_path), sent=sent).collect()
    got = {name: [] for name in want}
    for r in sorted(rows, key=lambda r: (r.path, r.place)):
        got[r.path.split("/")[-1].removesuffix(".json")].append(json.loads(r.value))
    for name, values in want.items():
        assert json.dumps(got[name]) == json.dumps(values), name
    assert len({(r.path, r.place) for r in rows}) == len(rows)


@pytest.mark.parametrize("split_bytes", ["40", "128m"], indirect=True)
@pytest.mark.parametrize("bad", ["[1, 2", '{"a": ', '{"a": 1} nonsense', '{"a": 1}}', '["x, y', '[{"a": 1, }, 2]', '[tru, 1]', '{"a": 1}, {"b": 2}'])
def test_what_is_malformed_is_refused(spark, tmp_path, split_bytes, bad):
    (tmp_path / "bad.json").write_text(bad)
    with pytest.raises(Exception, match="isn't closed|close more|JSONDecodeError"):
        json_split.split_values(spark, str(tmp_path)).collect()


def test_summaries_compose(spark):
    rng = random.Random(3)
    for _ in range(300):
        text = json.dumps([some_value(rng) for _ in range(4)]).encode()
        parts = text.split(b",")
        parts = [p + b"," for p in parts]
        left = json_split.Summary()
        for p in parts:
            left = left.then(json_split.summary(p))
        middle = len(parts) // 2
        halves = [json_split.summary(b"".join(parts[:middle])) if middle else json_split.Summary(), json_split.summary(b"".join(parts[middle:]))]
        assert left == halves[0].then(halves[1])
        assert (left.odd, left.change[0]) == (0, 0)


@pytest.mark.parametrize("split_bytes", ["20000"], indirect=True)
def test_one_line_in_many_tasks(spark, tmp_path, split_bytes):
    (tmp_path / "big.json").write_text(json.dumps([{"id": i, "text": f"line, {i} \\" * 3} for i in range(5000)]))
    got = files.json_values(spark, str(tmp_path))
    assert [json.loads(r.value)["id"] for r in got.orderBy("ordinal").collect()] == list(range(5000))
    assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 8
