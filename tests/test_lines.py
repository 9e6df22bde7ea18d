"""Line numbers and joins by line over many splits."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import dialogues, files, lines


@pytest.fixture
def split_bytes(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "30")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split_bytes", ["50", "170", "997", "128m"], indirect=True)
def test_numbered_lines(spark, tmp_path, split_bytes):
    rng = random.Random(1)
    want = {}
    for name, end in (("a", "\n"), ("b", "\r\n"), ("sub/c", "\n"), ("empty", "\n"), ("one", "\n")):
        path = tmp_path / f"{name}.txt"
        path.parent.mkdir(exist_ok=True)
        rows = ["é" * rng.randrange(0, 30) + str(i) for i in range({"empty": 0, "one": 1}.get(name, 120))]
        path.write_text(end.join(rows) + (end if name != "one" and rows else ""), encoding="utf-8", newline="")
        want |= {(str(path), i): v for i, v in enumerate(rows)}
    assert {(r.path, r.line): r.value for r in lines.numbered_lines(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("split_bytes", ["60", "300", "128m"], indirect=True)
def test_dailydialog_files(spark, tmp_path, split_bytes):
    for split, n in (("train", 40), ("validation", 7)):
        folder = tmp_path / "x" / split / ("deep" if split == "train" else "")
        folder.mkdir(parents=True)
        (folder / "dialogues_text.txt").write_text("".join(f"hi {i} __eou__ you {i} __eou__ \n" if i % 5 else f"only {i}\n" for i in range(n)))
        (folder / "dialogues_emotion.txt").write_text("".join(f"{i % 7} {(i + 1) % 8}\n" for i in range(n - 1)))  # one line too few
        if split == "train":
            (folder / "dialogues_act.txt").write_text("".join(f"{i} x 3\n" for i in range(n + 4)))  # and too many
    got = {r.id: r for r in dialogues.dailydialog_files(spark, str(tmp_path)).collect()}
    assert set(got) == {f"dailydialog-{s}-{i}" for s, n in (("train", 40), ("validation", 7)) for i in range(n) if i % 5}
    for key, r in got.items():
        i, split = int(key.rsplit("-", 1)[1]), r.split
        last = i == (39 if split == "train" else 6)
        names = [*dialogues.EMOTIONS, "unknown"]
        assert [t.text for t in r.turns] == [f"hi {i}", f"you {i}"]
        assert r.emotions == (["unknown"] * 2 if last else [names[i % 7], names[(i + 1) % 8]])
        assert r.acts == ([i, 3] if split == "train" else [None, None])


@pytest.mark.parametrize("split_bytes", ["60", "170", "250", "128m"], indirect=True)
def test_personachat_lines_of_several_files(spark, tmp_path, split_bytes):
    want = {}
    for name in ("train_a", "train_b", "sub/train_a"):
        path = tmp_path / f"{name}.txt"
        path.parent.mkdir(exist_ok=True)
        text = []
        for conv in range(6):
            text.append(f"1 your persona: i am {name} {conv}.")
            text += [f"{k} q {name} {conv} {k}\ta {name} {conv} {k}" for k in range(2, 7)]
            want[f"{name} {conv}"] = [x for k in range(2, 7) for x in (f"q {name} {conv} {k}", f"a {name} {conv} {k}")]
        path.write_text("\n".join(text) + "\n")
    got = dialogues.personachat_files(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == sorted([f"personachat-{s}-{i}" for s in ("train_a", "train_a", "train_b") for i in range(6)])
    assert {r.system.split("i am ")[1].rstrip("."): [t.text for t in r.turns] for r in got} == want


@pytest.mark.parametrize("split_bytes", ["60", "128m"], indirect=True)
def test_json_lines_keep_their_order(spark, tmp_path, split_bytes):
    for name in "abc":
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"{name}": {i}}}\n' + "\n" * (i % 3) for i in range(50)))
    got = [r.value for r in files.json_lines(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [f'{{"{name}":{i}}}' for name in "abc" for i in range(50)]


def test_zip_of_missing_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    (tmp_path / "b.txt").write_text("x\n")
    stem = F.regexp_extract("path", r"(\w+)\.txt$", 1)
    got = lines.zip_lines(lines.numbered_lines(spark, str(tmp_path)), stem, ["a", "b", "c"], []).orderBy("line").collect()
    assert [(r.line, r.a, r.b, r.c) for r in got] == [(0, "1", "x", None), (1, "2", None, None), (2, "3", None, None)]
