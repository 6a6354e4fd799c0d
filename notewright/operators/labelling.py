"""Labels by a service: its replies are kept by what was asked, so that nothing is asked twice."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import label_from_json, tidy_label
from notewright.operators.keyed import KeyedTable
from notewright.sources.shared import Scratch

#: Sends a request's body and waits so many seconds at most; returns the reply's text or raises.
Service = Callable[[dict, float], str]

#: Seconds that a request is waited for: the first time, the second, and so on.
SECONDS = (30.0, 60.0, 120.0)


class HttpService:
    """Posts the body as JSON to a chat service, and returns its message's text."""

    def __init__(self, url: str) -> None:
        self.url = url

    def __call__(self, body: dict, seconds: float) -> str:
        from urllib.request import Request, urlopen

        with urlopen(Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=seconds) as r:  # noqa: S310
            return json.loads(r.read())["message"]["content"]


def chat_request(said: Column, model: str) -> Column:
    """The body of a chat request as JSON text: temperature 0, a JSON reply with a label."""
    schema = F.from_json(F.lit('{"type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"]}'), "type string, properties struct<label: struct<type: string>>, required array<string>")
    message = F.struct(F.lit("user").alias("role"), said.alias("content"))
    options = F.struct(F.lit(0).alias("temperature"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(False).alias("stream"), schema.alias("format"), options.alias("options"), F.array(message).alias("messages")))


def topic_request(keywords: Column, documents: Column, model: str, most_documents: int = 5) -> Column:
    """Asks for a topic's label by its keywords and its first documents, which go whole; null for a topic that has neither."""
    none = F.array().cast("array<string>")
    words, texts = F.filter(F.coalesce(keywords, none), lambda x: x.isNotNull()), F.filter(F.coalesce(documents, none), lambda x: x.isNotNull())
    lines = F.transform(F.slice(texts, 1, most_documents), lambda d: F.concat(F.lit("\n- "), d))
    said = F.concat(F.lit("Give a label of two to five words for this topic, as JSON.\nKeywords: "), F.array_join(words, ", "), F.lit("\nDocuments:"), F.array_join(lines, ""))
    return F.when((F.size(words) > 0) | (F.size(texts) > 0), chat_request(said, model))


def heard(reply: Column) -> Column:
    """The label of a reply, tidied; null where it has none."""
    return F.nullif(F.trim(tidy_label(label_from_json(reply, F.lit(None).cast("string")))), F.lit(""))


class Replies:
    """Replies of a service, a row for each different request: key, request, reply (null: none yet), failures, error.

    A row's key is the SHA-256 of its request, so an equal request is answered from here whichever topic, run or table
    it comes from, and a changed one is asked anew.  A reply without a label counts as a failure.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        self.spark, self.table = spark, KeyedTable(spark, root)
        if not self.table.pointer.version():
            KeyedTable.create(spark.createDataFrame([], "key string, request string, reply string, failures int, error string"), root, ["key"], buckets)

    def read(self) -> DataFrame:
        return self.table.read()

    def ask(self, requests: Column, rows: DataFrame, service: Service, seconds: Sequence[float] = SECONDS, tasks: int = 8, workers: int = 4, batch: int = 2000) -> None:
        """Asks what these rows request and no reply is kept for, each different request once; null requests aren't asked.

        At most tasks * workers requests are under way at once.  Requests go in batches of about `batch`, and a batch's
        replies are kept in one step: a driver that dies loses those of one batch, a task that is run again asks its
        share of a batch again.  What failed is asked again, after all others, with the next time of `seconds`; what
        fails with the last one stays without a reply, and the next call begins with it from the first again.
        """
        scratch = Scratch(self.spark, "asked")
        wanted = rows.select(requests.alias("request")).where("request is not null").distinct()
        wanted = scratch.write(wanted.withColumn("key", F.sha2("request", 256)), "wanted")
        for wait in seconds:
            known = self.read()
            todo = wanted.join(known.where("reply is not null").select("key"), "key", "left_anti")
            n = todo.count()
            if not n:
                break
            before = known.select("key", F.col("failures").alias("before"))
            parts = -(-n // batch)
            for part in range(parts):
                now = todo.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).repartition(tasks, "key")
                got = scratch.write(now.select("key", "request").mapInPandas(_asking(service, wait, workers), "key string, request string, said string, error string"), "got")
                new = got.withColumn("reply", F.when(heard(F.col("said")).isNotNull(), F.col("said")))
                new = new.withColumn("error", F.when(F.col("reply").isNull(), F.coalesce("error", F.lit("no label in the reply"))))
                failed = (F.coalesce("before", F.lit(0)) + F.col("reply").isNull().cast("int")).cast("int")
                self.table.upsert(new.join(before, "key", "left").select("key", "request", "reply", failed.alias("failures"), "error"))
        scratch.drop_all_but()
        self.table.vacuum()


def _asking(service: Service, wait: float, workers: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one(request: str) -> tuple[str | None, str | None]:
        try:
            return service(json.loads(request), wait), None
        except Exception as e:  # noqa: BLE001  whatever goes wrong with a request is kept beside it, and it is asked again
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for part in batches:
                said = list(pool.map(one, part["request"]))
                yield part.assign(said=pd.Series([s for s, _ in said], index=part.index, dtype=object), error=pd.Series([e for _, e in said], index=part.index, dtype=object))

    return run


def label_by_service(found: DataFrame, replies: Replies, service: Service, request: Column, otherwise: Column, **how: object) -> DataFrame:
    """found with label and label_source: `service`, or `fallback` where no reply came or none was asked for.

    request: the body's text of a row; otherwise: its label without the service.  Rows are as many as before, those of
    equal requests share a reply; columns of found named label or label_source are replaced.
    """
    scratch = Scratch(found.sparkSession, "labelled")
    rows = scratch.write(found.drop("label", "label_source").withColumns({"_nw_request": request, "_nw_otherwise": otherwise}), "found")
    replies.ask(F.col("_nw_request"), rows, service, **how)
    said = replies.read().select(F.col("key").alias("_nw_key"), heard(F.col("reply")).alias("_nw_said"))
    out = rows.join(said, F.sha2("_nw_request", 256) == F.col("_nw_key"), "left")
    out = out.withColumn("label", F.coalesce("_nw_said", "_nw_otherwise")).withColumn("label_source", F.when(F.col("_nw_said").isNotNull(), "service").otherwise("fallback"))
    return out.drop("_nw_key", "_nw_said", "_nw_request", "_nw_otherwise")
