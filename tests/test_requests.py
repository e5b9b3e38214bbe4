"""The request log: passes that break go on where they stopped; both passes before an extraction."""

import json
from collections import Counter

import pytest

from hyperloom.operators import requests
from hyperloom.operators.hooks import FatalReply
from hyperloom.operators.requests import Log


def asking(path, breaks_at=None, answer=lambda k: len(k)):
    """A service that writes down what it is asked, and breaks once it was asked for a certain key."""

    def call(keys):
        with open(path, "a") as f:
            f.writelines(k + "\n" for k in keys)
        if breaks_at in keys:
            raise FatalReply("quota")
        return [answer(k) for k in keys]

    return call


def asked(path):
    return Counter(path.read_text().split()) if path.exists() else Counter()


def test_a_broken_pass_goes_on_where_it_stopped(spark, tmp_path):
    seen, keys = tmp_path / "asked", spark.createDataFrame([(f"k{i:03d}",) for i in range(400)] * 2 + [(None,)], "k string")
    log = Log(spark, str(tmp_path / "log"), "m1", batch=5, batches_per_task=2, round_size=50)
    with pytest.raises(Exception, match="quota"):
        log.answered(keys, asking(seen, "k123"), "int")
    kept, first = {r.request for r in log.rows("int").collect()}, asked(seen)
    assert 0 < len(kept) < 400 and "k123" not in kept
    seen.unlink()
    out = log.answered(keys, asking(seen), "int").collect()
    again = asked(seen)
    assert len(out) == 400 and all(r.answer == 4 for r in out)
    assert not again.keys() & kept and set(again.values()) == {1}  # nothing that was answered is asked again
    lost = [k for k in first if k not in kept]
    assert 0 < len(lost) <= 4 * 50  # the round that broke, with Spark's retries of its task
    seen.unlink()
    assert log.answered(keys, asking(seen), "int").count() == 400 and not asked(seen)
    more = spark.createDataFrame([("k001",), ("new",)], "k string")
    assert {r.request: r.answer for r in log.answered(more, asking(seen), "int").collect()} == {"k001": 4, "new": 3}
    assert asked(seen) == {"new": 1}
    assert [p for p in tmp_path.iterdir() if ".open-" in p.name] == []


def test_null_answers_and_models(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("bb",), ("",)], "k string")
    log = Log(spark, str(tmp_path / "log"), "m1")
    none_for_a = lambda k: None if k == "a" else len(k)
    assert {r.request: r.answer for r in log.answered(keys, asking(tmp_path / "x", answer=none_for_a), "int").collect()} == {"a": None, "bb": 2, "": 0}
    assert log.missing(keys, "int").count() == 0, "a null answer is one"
    other = Log(spark, str(tmp_path / "log"), "m2")
    assert other.missing(keys, "int").count() == 3
    with pytest.raises(requests.OtherModel):
        Log(spark, str(tmp_path / "log"), "m2", strict=True).answered(keys, asking(tmp_path / "x"), "int")
    assert log.answered(keys.limit(0), asking(tmp_path / "x"), "int").count() == 0


def test_empty_batches_are_asked_again_in_halves():
    calls = []

    def call(keys):
        calls.append(list(keys))
        return [[] if len(keys) > 2 else [k] for k in keys]

    assert requests.careful(call, ["a", "b", "c", "d"]) == [["a"], ["b"], ["c"], ["d"]]
    assert calls == [["a", "b", "c", "d"]] * 2 + [["a", "b"], ["c", "d"]]
    assert requests.careful(lambda k: [[]], ["a"]) == [[]]
    with pytest.raises(FatalReply):
        requests.careful(lambda k: [1], ["a", "b"])


def test_cache_files(spark, tmp_path):
    found = {"source_domain": "war", "target_domain": "love", "ground": ["pain"], "triggers": ["won"], "confidence": 0.7}
    (tmp_path / "d.json").write_text(json.dumps({"he won": [found], "none": []}, ensure_ascii=False))
    rows = requests.discovery_file(spark, str(tmp_path / "d.json"))
    got = {r.request: [x.asDict() for x in r.answer] for r in rows.collect()}
    assert got == {"he won": [found], "none": []}
    log = Log(spark, str(tmp_path / "log"), "m1")
    requests.from_file(log, rows)
    kind = rows.schema["answer"].dataType.simpleString()
    keys = spark.createDataFrame([("he won",), ("none",), ("fresh",)], "k string")
    assert [r.request for r in log.missing(keys, kind).collect()] == ["fresh"]
    (tmp_path / "v.json").write_text(json.dumps([[["he won", "war", "love"], {"is_metaphor": True, "confidence": 0.8, "ground": ["x"]}], [["t", "a", "b"], None]]))
    got = {r.text: (r.source_domain, r.figurative, r.confidence, r.ground) for r in requests.verdict_file(spark, str(tmp_path / "v.json")).collect()}
    assert got == {"he won": ("war", True, 0.8, ["x"]), "t": ("a", False, None, None)}


def test_keys_are_worked_out_once_to_be_asked(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def told(frames):
        for f in frames:
            read.add(len(f))
            yield f

    keys = spark.range(300, numPartitions=4).selectExpr("concat('k', id % 100) AS k").mapInPandas(told, "k string")
    log = Log(spark, str(tmp_path / "log"), "m1", batch=5, batches_per_task=2, round_size=30)
    seen = tmp_path / "asked"
    assert log.answered(keys, asking(seen), "int").count() == 100
    assert asked(seen) == {f"k{i}": 1 for i in range(100)}
    assert read.value <= 600  # once to ask, once to answer


def test_rounds_are_whole_slots():
    assert requests.rounds_of({}, 5) == []
    assert requests.rounds_of({9: 2, 1: 3, 4: 2, 7: 8, 8: 1}, 5) == [(1, 4, 5), (7, 7, 8), (8, 9, 3)]
