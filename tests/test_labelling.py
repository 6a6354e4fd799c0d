"""A labelling service that fails at random: each request is answered once, and nothing is asked twice."""

import hashlib
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from notewright.operators.labelling import Replies, chat_request, heard, label_by_service, topic_request

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests

ROWS = "topic string, keywords array<string>, documents array<string>, label string"


class Service:
    """Writes a file for each call; a request fails its first `bad` times, by its hash, and waits grow."""

    def __init__(self, folder, never=(), silent=()):
        self.folder, self.never, self.silent = str(folder), never, silent

    def __call__(self, body, seconds):
        said = body["messages"][0]["content"]
        key = hashlib.md5(said.encode()).hexdigest()
        calls = len([f for f in os.listdir(self.folder) if f.startswith(key)])
        with open(f"{self.folder}/{key}-{calls}-{seconds:g}-{os.urandom(4).hex()}", "w"):
            pass
        word = said.split("Keywords: ")[1].split("\n")[0].split(", ")[0]
        if word in self.never or calls < int(key[0], 16) % 3:
            raise TimeoutError(word)
        return "no idea" if word in self.silent else json.dumps({"label": f" '{word}!' . \nmore"}) if calls == 0 else f"```json\n{json.dumps({'label': word + '.'})}\n```"

    def calls(self):
        return sorted(tuple(f.split("-")[:3]) for f in os.listdir(self.folder))


def rows(spark, n):
    return spark.createDataFrame([(f"{i}", [f"w{i}", "x"], [f"text {i}", None], "old") for i in range(n)], ROWS)


def test_each_is_asked_until_it_is_answered(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    service, replies = Service(tmp_path / "calls"), Replies(spark, f"{tmp_path}/replies")
    found = rows(spark, 40).unionByName(rows(spark, 10))  # repeated rows share a request
    request = topic_request(F.col("keywords"), F.col("documents"), "m")
    out = label_by_service(found, replies, service, request, F.lit("plain"), seconds=(1, 2, 4), tasks=3, workers=4, batch=9)
    assert out.columns == ["topic", "keywords", "documents", "label", "label_source"]
    got = out.collect()
    assert len(got) == 50 and {r.label_source for r in got} == {"service"}
    assert all(r.label.rstrip("!'").startswith(f"w{r.topic}") for r in got)
    kept = {r.key: r for r in replies.read().collect()}
    assert len(kept) == 40
    calls = service.calls()
    for r in kept.values():
        said = json.loads(r.request)["messages"][0]["content"]
        mine = [c for c in calls if c[0] == hashlib.md5(said.encode()).hexdigest()]
        assert [c[2] for c in mine] == ["1", "2", "4"][: r.failures + 1] and r.error is None  # longer each time, and no more after the reply
    again = label_by_service(rows(spark, 43), replies, service, request, F.lit("plain"), seconds=(1, 2, 4)).collect()
    more = [c for c in service.calls() if c not in calls]
    assert len(again) == 43 and len({c[0] for c in more}) == 3  # only those that are new


def test_fallback_and_defined_cases(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    service, replies = Service(tmp_path / "calls", never=("w1",), silent=("w2",)), Replies(spark, f"{tmp_path}/replies")
    odd = spark.createDataFrame([("n", None, None, None), ("e", [], [None], None), ("l", ["long"], ["y" * 500_000], None), ("u", None, ["only text"], None)], ROWS)
    found = rows(spark, 3).unionByName(odd)
    request = topic_request(F.col("keywords"), F.col("documents"), "m")
    got = {r.topic: r for r in label_by_service(found, replies, service, request, F.concat(F.lit("T"), "topic"), seconds=(1, 1, 1)).collect()}
    assert {t: got[t].label for t in ("1", "2", "n", "e")} == {"1": "T1", "2": "T2", "n": "Tn", "e": "Te"}
    assert {t for t, r in got.items() if r.label_source == "service"} == {"0", "l"}  # u has no keyword that the service could use
    errors = {json.loads(r.request)["messages"][0]["content"].split("Keywords: ")[1][:2]: r for r in replies.read().where("reply is null").collect()}
    assert errors["w1"].failures == 3 and "TimeoutError" in errors["w1"].error and errors["w2"].error == "no label in the reply"
    assert any("y" * 500_000 in json.loads(r.request)["messages"][0]["content"] for r in replies.read().collect())
    empty = label_by_service(rows(spark, 0), replies, service, request, F.lit("x"))
    assert empty.count() == 0 and "label_source" in empty.columns


def test_a_driver_that_dies_keeps_its_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    service, replies = Service(tmp_path / "calls"), Replies(spark, f"{tmp_path}/replies")
    request, n = topic_request(F.col("keywords"), F.col("documents"), "m"), 0
    upsert = replies.table.upsert

    def dies(rows):
        nonlocal n
        n += 1
        if n == 3:
            raise RuntimeError("gone")
        return upsert(rows)

    monkeypatch.setattr(replies.table, "upsert", dies)
    with pytest.raises(RuntimeError, match="gone"):
        replies.ask(request, rows(spark, 40), service, (1, 2, 4), batch=8)
    kept = {r.request for r in Replies(spark, f"{tmp_path}/replies").read().where("reply is not null").collect()}
    calls = service.calls()
    assert kept
    Replies(spark, f"{tmp_path}/replies").ask(request, rows(spark, 40), service, (1, 2, 4))
    answered = {hashlib.md5(json.loads(r)["messages"][0]["content"].encode()).hexdigest() for r in kept}
    assert not [c for c in service.calls() if c not in calls and c[0] in answered]
    assert Replies(spark, f"{tmp_path}/replies").read().where("reply is null").count() == 0


def test_request_and_reply(spark):
    body = json.loads(spark.range(1).select(chat_request(F.lit('say "x"\n'), "m").alias("r")).first()["r"])
    assert body == {"model": "m", "stream": False, "format": {"type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"]}, "options": {"temperature": 0}, "messages": [{"role": "user", "content": 'say "x"\n'}]}
    said = ['{"label": "A b."}', '```json\n{"label": "\'c\'"}\n```', '{"label": ""}', "{}", "junk", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(heard(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == ["A b", "c", None, None, None, None]
