"""The pipeline's stages take effect, in order, and keep the columns of documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from notewright.llm.queries import QUERIES, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "mixing sources"]
    docs = table(spark, DIR, "documents")
    columns, seen = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, seen, DIR).cache()
        assert after.columns == columns
        assert 0 < after.count() <= seen.count()
        assert after.join(seen, "doc_id", "left_anti").count() == 0
        seen = after
    near = QUERIES["op9_jaccard_join"].__globals__["near_duplicates"]
    assert near(corpus_pipeline.near(spark, docs, DIR)).where("doc_id <> component_id").count() == 0
    assert seen.where(F.col("n_chars") != F.char_length("text")).count() == 0
    mixed = corpus_pipeline.mix(spark, seen, DIR)
    assert mixed.where("mix_taken <= 0 or mix_taken > 3 * mix_size").count() == 0
    assert corpus_pipeline.run(spark, DIR).count() == mixed.count()


def test_stages_on_an_empty_table(spark):
    docs = table(spark, DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_stages_with_clashing_columns(spark):
    docs = table(spark, DIR, "documents")
    more = "kept n_hit _text _id size perplexity component_id threshold items spans taken _order target h cls n p blob".split()
    wide = docs.select("*", *(F.lit("x").alias(c) for c in more))
    for (_, stage), narrow in zip(corpus_pipeline.STAGES[:4], (docs,) * 4):
        got = stage(spark, wide, DIR)
        assert got.columns == wide.columns
        assert got.count() == stage(spark, narrow, DIR).count()
    assert corpus_pipeline.mix(spark, wide, DIR).count() == corpus_pipeline.mix(spark, docs, DIR).count()


def test_stages_with_nulls_and_repeated_rows(spark):
    docs = table(spark, DIR, "documents").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some words here. and there.", "en", "s", 1), (10**6, "", None, None, 0), (10**6, "", None, None, 0), (10**6 + 1, None, "xx", "", None)], docs.schema)
    both = docs.unionByName(odd).unionByName(docs.limit(5))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, both, DIR).count() > 0


def test_run_is_its_stages_slow_twins(spark, tmp_path):
    """The whole pipeline on a small corpus against plain loops."""
    import random
    import slow

    rng = random.Random(21)
    words = "the of and to in that was for with his from they have this not but had her which all were when there one more would will what out up been its".split()
    say = lambda n: " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = f"{plain(15)}. {plain(15)}."
    items = [(i, say(n)) for i, n in enumerate((25, 40, 4))]
    texts = [say(rng.choice((30, 60, 120))) for _ in range(150)]
    texts += [" ".join([*t.split()[:-1], "were"]) for t in texts[:12]] + texts[20:24]  # near copies and copies
    texts += [f"{say(30)}. {passage} {say(20)}" for _ in range(5)]
    texts += [f"{say(30)} {t} {say(10)}" for _, t in items[:2]]
    texts += ["".join(chr(rng.randint(33, 126)) for _ in range(300)) for _ in range(4)] + ["", None, None]
    rows = [(i, t, rng.choice(("en", "en", "fr", None)), rng.choice(("a", "a", "b", "c", None)), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i < 140), 0) for i in range(180)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    good = slow.kept_by_quality(docs, labels)
    left = sorted(r for r in rows if r[0] in good)
    assert 120 < len(left) < len(rows)
    sets, group = slow.near([r[1] for r in left])
    once = [r for k, r in enumerate(left) if group[k] == k]  # sorted by id: the first of a group has the smallest
    assert len(once) <= len(left) - 8
    cut = slow.without_repeated([(i, t) for i, t, *_ in once])
    cut = [(i, t, lang, source, len(t) if gone else n) for (i, t, _, gone), (_, _, lang, source, n) in zip(cut, once) if not gone or t]
    assert sum(a[1] != b[1] for a, b in zip(cut, once)) >= 1 or len(cut) < len(once)
    clean = [r for r in cut if not slow.hits(r[1], items)[1]]
    assert len(clean) <= len(cut) - 2
    taken = slow.mixed(spark.createDataFrame(clean, schema), lambda names: [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])
    want = sorted((*map(str, r), len(slow.split(r[1])), taken[r[0]]) for r in clean if r[0] in taken)
    got = corpus_pipeline.run(spark, str(tmp_path), "twin")
    assert sorted((*map(str, r[:5]), r.mix_size, r.mix_taken) for r in got.collect()) == want
    again = corpus_pipeline.run(spark, str(tmp_path), "twin")  # all its stages are there
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    other = f"{tmp_path}/other"
    docs.limit(0).write.parquet(f"{other}/documents.parquet")
    labels.write.parquet(f"{other}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{other}/benchmark.parquet")
    assert corpus_pipeline.run(spark, other, "twin").count() == 0  # of the same name, from other files
