"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import slow
from slow import lower, split

from notewright.llm import chat, decontaminate, languages, language_model, license_scan, quality_rules, substring_dedup, token_counts
from notewright.llm._kernel import ALNUM, SPACED, span_hashes, texts, windows, words
from notewright.llm.components import components
from notewright.llm.jaccard_join import Bands, near_duplicates
from notewright.llm.mixing import mix_sources, sainte_lague, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, _id string, size string"
WORDS = ["the", "of", "and", "alpha", "béta", "Gamma", "delta", "ÉPSILON", "zeta,", "eta.", "théta", "iota", "kappa!", "lambda", "mu", "xi"]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 30))]))
        out.append(rng.choice([" ", " ", " ", "  ", "\n", "\t"]))
    return "".join(out)


def table(spark, rows):
    full = [(i, t, lang, source, len(t or ""), "x", "y", "z") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 3, 4, 5, 6, 9, 40, 120, 400])) for _ in range(70)]
    for _ in range(60):  # near copies of every degree
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        base.append(" ".join(w))
    base += [base[3], base[3], base[20], "", " \n ", None, None, "one two three", "One two three", "x" * 5000, prose(rng, 20000)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None])) for i, t in enumerate(base)]
    rows += [rows[8], rows[8], (None, base[9], "en", "s1")]
    return rows


@pytest.mark.parametrize("inside,pattern", [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_the_patterns(corpus, inside, pattern):
    corpus = [(i, t if inside is SPACED or t is None else lower(t), a, b) for i, t, a, b in corpus]  # the second pattern is for lowered text
    column = pa.array([t for _, t, _, _ in corpus])
    got = []
    for t in texts(column, 300):
        w = words(t, inside)
        for r in range(t.hi - t.lo):
            got.append([bytes(t.data[a:b]).decode() for a, b in zip(w.starts[w.first[r] : w.first[r + 1]], w.ends[w.first[r] : w.first[r + 1]])])
    assert got == [split(t, pattern) for _, t, _, _ in corpus]
    t = next(texts(pa.array(["ab cd", None, "ab", "cd ab x"])))
    w = words(t, SPACED)
    h = span_hashes(t.data, w.starts, w.ends)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h)) == 3
    assert windows(w, 2)[0].tolist() == [0, 3, 4]


def test_sainte_lague_is_the_seat_by_seat_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w, most, seats = rng.choice([0, 1, 2, 5, 7.5, 30], 6), rng.integers(0, 9, 6), int(rng.integers(0, 40))
        have = np.zeros(6, int)
        for _ in range(seats):
            q = np.where((have < most) & (w > 0), w / (2 * have + 1), -1)
            if q.max() < 0:
                break
            have[int(q.argmax())] += 1
        got = sainte_lague(w, seats, most)
        assert got.sum() == have.sum()
        assert sorted(w / (2 * got + 1)) == pytest.approx(sorted(w / (2 * have + 1)))


def test_targets_are_capped_and_shared_again():
    assert targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert targets([], []) == [] and targets([0, 0], [1, 1]) == [0, 0]


def test_mixing(spark, corpus):
    docs = table(spark, corpus)
    weigh = lambda names: [5.0, 2.0, 1.0, 5.0][: len(names)]
    got = mix_sources(docs, weigh, shard_docs=16).toPandas()
    again = mix_sources(docs.repartition(7), weigh, shard_docs=16).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got.sort_values(key)[key].fillna(-1).values.tolist() == again.sort_values(key)[key].fillna(-1).values.tolist()
    assert len(got) == len(corpus) and (got.taken <= 3 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len(split(t)) for _, t, _, _ in corpus)
    for _, g in got.groupby("source", dropna=False):
        assert g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(5, 0.02 * g.target.iloc[0])
    assert mix_sources(table(spark, []), weigh).count() == 0
    assert mix_sources(docs, lambda names: [0.0] * len(names)).where("taken > 0").count() == 0


@pytest.mark.parametrize("group", [1024, 3])
def test_mixing_is_seat_by_seat_and_block_by_block(spark, corpus, monkeypatch, group):
    """Blocks, quotas and what is taken of each document, by plain loops over a line of words in each shard."""
    from notewright.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", group)
    rows = list({r[0]: r for r in corpus if r[0] is not None}.values())
    docs = table(spark, rows)
    weigh = lambda names: [5.0, 2.0, 1.0, 5.0][: len(names)]
    got = {r.doc_id: r.taken for r in mix_sources(docs, weigh, shard_docs=16, max_block=8, keep=("tokens",)).where("taken > 0 and tokens = 'x'").collect()}
    assert got == slow.mixed(docs, weigh, 16, 8, group) and len(got) > 50


def test_mixing_deals_equal_rows(spark, monkeypatch):
    """A source of equal rows is as many shards as any other, whatever the partitions."""
    from notewright.llm import mixing

    monkeypatch.setattr(mixing, "PIECE", 50)
    rows = [(None, "same words here", "en", "hot")] * 3000 + [(None, None, None, None)] * 1500 + [(i, "a b " * (i % 9), "en", "cold") for i in range(400)]
    docs = table(spark, rows)
    seen = []
    deal = mixing._dealt
    monkeypatch.setattr(mixing, "_dealt", lambda *a: seen.append(deal(*a)) or seen[-1])
    runs = []
    for turn in (docs, docs.repartition(5)):
        got = mix_sources(turn, lambda names: [1.0, 2.0, 1.0][: len(names)], shard_docs=16).toPandas()
        for _, g in got.groupby("source", dropna=False):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= max(5, 0.02 * g.target.iloc[0])
        assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
        runs.append(Counter(zip(got.doc_id.fillna(-1), got["size"], got.taken)))
        shards = seen[-1].groupBy("_nw_source", "_nw_shard").count().toPandas()
        assert shards["count"].max() < 64 and shards["count"].sum() == len(rows) and len(shards) > 280
    assert runs[0] == runs[1] and len(seen) == 2


def test_near_duplicates(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    sets, group = slow.near([t for _, t, _, _ in rows])
    least = defaultdict(lambda: 10**9)
    for g, r in zip(group, rows):
        least[g] = min(least[g], r[0])
    want = Counter((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group))
    got = Counter(map(tuple, near_duplicates(table(spark, rows)).collect()))
    assert got == want
    assert len(set(least.values())) < len(rows) - 20  # there are links
    assert near_duplicates(table(spark, [])).count() == 0
    assert near_duplicates(table(spark, corpus)).count() == len(corpus)


def test_near_duplicates_with_dear_keys(spark, monkeypatch):
    """A large group of near copies and a passage that all documents have: keys of many sets, in small blocks."""
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(12))
    texts_ = []
    origin = [f"o{i}" for i in range(60)]
    for i in range(120):
        w = list(origin)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randint(0, 10**6)}"
        texts_.append(" ".join(w))
    for i in range(120):
        own = " ".join(f"d{i}x{j}" for j in range(rng.randint(1, 30)))
        texts_.append(f"{common} {own}")
    texts_ += texts_[200:210]
    rng.shuffle(texts_)
    rows = [(i, t, None, None) for i, t in enumerate(texts_)]
    from notewright.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts_)]
    comp = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    got = {r[0]: r[2] for r in near_duplicates(table(spark, rows)).collect()}
    assert got == dict(enumerate(comp))


@pytest.mark.parametrize("cheap", [1, 3])
def test_near_duplicates_of_short_texts(spark, monkeypatch, cheap):
    """Short sets, matched within one deletion, with nearly all keys dear."""
    from notewright.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CHEAP", cheap)
    rng = random.Random(11)
    texts_ = []
    for _ in range(40):
        w = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(5, 34))]
        for _ in range(8):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                spot = rng.choice([0, len(v) - 1, rng.randrange(len(v))])
                v[spot : spot + rng.randint(0, 1)] = [f"w{rng.randint(0, 40)}"] * rng.randint(0, 2)
            texts_.append(" ".join(v))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.split()) else frozenset() for t in texts_]
    comp = list(range(len(texts_)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in range(len(texts_)):
        before = list(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    assert sum(sets[i] != sets[j] for i, j in links) > 100
    got = {r[0]: r[2] for r in near_duplicates(table(spark, [(i, t, None, None) for i, t in enumerate(texts_)])).collect()}
    assert got == dict(enumerate(comp))


def test_keys_of_near_duplicates_take_few_bytes(spark, monkeypatch):
    """A set is named once for its keys in a bucket, and ranges of a bucket meet like the whole."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from notewright.llm import _blobs, jaccard_join
    from notewright.llm._kernel import texts

    rng = random.Random(5)
    texts_ = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(80, 160))) for _ in range(1500)]
    texts_ += [t.replace("w1", "v1", 1) for t in texts_[:40]]
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts_)]).repartition(2)
    bands = Bands.make(4, 5, True)
    n_keys = sum(len(jaccard_join.keys(jaccard_join.shingle_sets(t, 5), bands).key) for t in texts(pa.array(texts_)))
    sent, deal = [], _blobs.dealt
    monkeypatch.setattr(_blobs, "dealt", lambda df, *a: sent.append(df) or deal(df, *a))
    found = []
    for meet in (10**9, 1000):
        monkeypatch.setattr(jaccard_join, "MEET", meet, raising=False)
        rows = jaccard_join._meetings(docs.select(F.col("text").alias("_text")), 5, bands).where("b is not null").select("a", "b").distinct()
        found.append({tuple(r) for r in rows.collect()})
    assert found[0] == found[1] and len(found[0]) >= 40
    assert sent[0].agg(F.sum(F.length("blob"))).first()[0] < 10 * n_keys  # 11.3 when a bucket had 500 documents
    x = np.sort(np.array([0, 0, 5, 2**31, 2**32 - 1, *np.random.default_rng(1).integers(0, 2**32, 500)], np.uint32))
    assert (_blobs.summed(_blobs.steps(x)) == x).all() and len(_blobs.summed(_blobs.steps(x[:0]))) == 0


def test_bands_hold_every_pair_of_sizes():
    b = Bands.make(4, 5, 3000)
    for n in range(1, 2000):
        for other in {n, n * 5 // 4, (n + n * 5 // 4) // 2}:
            both = (b.low <= n) & (other <= b.high)
            assert both.any()
            for k in np.flatnonzero(both):
                apart = (n + other) // 9  # tokens, and so segments that can differ; under deletions it takes two for each
                assert (apart // 2 if b.deletions[k] else apart) <= b.parts[k] - b.spare[k] - 1


def test_components(spark):
    links = [(5, 3), (3, 9), (1, 2), (7, 7), (20, 19), (19, 18), (18, 17), (17, 16), (None, 4), (3, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if k != 7} == {3: 3, 5: 3, 9: 3, 1: 1, 2: 1, **{i: 16 for i in range(16, 21)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination(spark, corpus, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)  # the join by a broadcast, or by a shuffle
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([2, 5, 9, 10, 11, 40, 60])] + [(7, ""), (8, None), (9, "Alpha"), (9, "mu xi"), (None, "nothing like it anywhere"), (10, corpus[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = corpus + [(1000 + i, f"{prose(rng, 7)} {t} {prose(rng, 3)} {t}", None, None) for i, t in items if t and i is not None]
    want = Counter()
    for i, t, _, _ in rows:
        w, hit, got = slow.hits(t, items)
        want[i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)] += 1
    docs = table(spark, rows)
    assert Counter(map(tuple, decontaminate.digest(decontaminate.contamination(docs, bench)).collect())) == want
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)
    assert decontaminate.contamination(table(spark, []), bench).count() == 0
    kept = decontaminate.contamination(docs, bench, keep=("text", "tokens"))
    assert kept.where("n_hit > 0").selectExpr("sum(aggregate(spans, 0L, (s, x) -> s + x.end - x.start)) = sum(n_hit)").first()[0]


def test_substring_dedup(spark, corpus):
    rng = random.Random(2)
    passage = "A first sentence of nine words stands right here. And then a second one of as many words again. Short one. The last sentence of them all is rather long too."
    rows = [(i, t, None, None) for i, t, _, _ in corpus if i is not None and i < 20] + [(100 + i, f"{prose(rng, 30)}.\n{passage}\n{prose(rng, 30)}", None, None) for i in range(6)] + [(50, passage, None, None), (None, passage, None, None)]

    brute = lambda rows: Counter(slow.without_repeated([(i, t) for i, t, _, _ in rows]))
    got = substring_dedup.remove_repeated(table(spark, rows).repartition(3))
    assert Counter(map(tuple, got.select("doc_id", "text", "_nw_sentences", "_nw_removed").collect())) == brute(rows)
    assert got.where("_nw_removed > 0").count() >= 6
    assert substring_dedup.remove_repeated(table(spark, [])).count() == 0
    one = substring_dedup.remove_repeated(table(spark, rows[:5] * 2))
    assert one.count() == 10


def test_sentences_of_scripts_without_blanks(spark):
    passage = "今天天气很好我们一起去公园散步。然后在湖边喝茶聊天直到傍晚才回家！第二天又下雨了所以大家都留在家里读书写字？"
    rows = [(1, f"第一篇文章的开头不一样。{passage}结尾也不同。", None, None), (2, f"另一篇的开头。{passage}", None, None), (3, "短句。短句。", None, None), (4, "短句。短句。", None, None)]
    got = {r.doc_id: (r.text, r["_nw_sentences"], r["_nw_removed"]) for r in substring_dedup.remove_repeated(table(spark, rows)).collect()}
    assert got[1][1:] == (5, 0) and got[2] == ("另一篇的开头。", 4, 3) and got[3] == got[4] == ("短句。短句。", 2, 0)


def test_quality_rules(spark, corpus):
    got = quality_rules.quality_rules(table(spark, corpus)).collect()

    def brute(t):
        w = split(t)
        n = len(w)
        c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        cover = {i + k for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)

    want = Counter((i, *brute(t)) for i, t, _, _ in corpus)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1
    noisy = [(i, "the of and alpha delta mu xi iota " * 1 + prose(random.Random(i), 200), "en", None) for i in range(60)] + [(99, " ".join(f"a{i}***%%%&&&" for i in range(120)), "en", None)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(table(spark, noisy)).collect()}
    assert not kept.pop(99) and sum(kept.values()) >= 55
    assert quality_rules.quality_rules(table(spark, [])).count() == 0
    p, q = np.array([[1.0, 0.0], [2.0, 2.0]]), np.array([[0.0, 1.0], [1.0, 1.0]])
    assert quality_rules.jensen_shannon(p, q) == pytest.approx([1, 0])


@pytest.mark.parametrize("broadcast,held", [(4096, 400_000), (0, 5)])
def test_quality_rules_distances_and_verdict(spark, corpus, monkeypatch, broadcast, held):
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", broadcast)
    monkeypatch.setattr(quality_rules, "HELD", held)
    rows = [*corpus, (5000, prose(random.Random(1), 90), "rare", None), (5001, "short", "none that passes", None)]
    got = quality_rules.quality_rules(table(spark, rows)).collect()
    near = lambda rows: sorted((-1 if r[0] is None else r[0], *(round(x, 7) for x in r[1:])) for r in rows)
    assert near((r.doc_id, r.class_distance, r.word_distance) for r in got) == near((i, *d) for (i, *_), d in zip(rows, slow.rules([(lang, t) for _, t, lang, _ in rows], quality_rules.COMMON)))
    for r in got:
        assert r.kept == (not r.base_failed and r.class_distance <= 0.2 and r.word_distance <= 0.5)


def test_quality_rules_without_lang(spark):
    clean = [(i, prose(random.Random(i), 200), None, None) for i in range(40)]
    by_id = lambda rows: {r.doc_id: (r.kept, r.class_distance, r.word_distance) for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    got = by_id(clean)
    assert sum(kept for kept, _, _ in got.values()) >= 36  # their reference is that of all documents
    named = by_id([(i, t, "en", s) for i, t, _, s in clean])
    assert all(got[i] == pytest.approx(named[i]) for i in got)
    # a third has no lang and another script: the pool holds all of it, a language only its own
    other = [(100 + i, t.translate({c: c + 0x3A0 for c in range(0x61, 0x7B)}), None, None) for i, t, _, _ in clean[:20]]
    both = [(i, t, "en", s) for i, t, _, s in clean] + other
    mixed = by_id(both)
    assert all(mixed[i] == pytest.approx(named[i]) for i in named)
    assert all(mixed[i][1:] == pytest.approx(d) for (i, *_), d in zip(both, slow.rules([(k, t) for _, t, k, _ in both], quality_rules.COMMON)))


ENGLISH = "the and that with this from have which were their what when there about would people into them some could other than then its only over also after two how our work first well way even new want because any these give day most"
GERMAN = "der die und das nicht mit sich auf für ist dem den ein eine als auch nach wird bei einer wurde über sein noch werden aus hat dass sie nach einem durch wenn kann oder aber vor zur bis mehr haben man unter schon nur war sehr"


def test_language_mixture(spark):
    rng = random.Random(1)
    say = lambda pool, n: " ".join(rng.choice(pool.split()) for _ in range(n))
    rows = [(i, say(ENGLISH if i % 2 else GERMAN, 60), "en" if i % 2 else "de", None) for i in range(80)]
    rows += [(200, f"{say(ENGLISH, 150)} {say(GERMAN, 150)}", None, None), (201, None, "en", None), (202, "123 !?", "en", None), (203, "", "de", None), (204, "a", None, None)]
    docs = table(spark, rows)
    model = languages.train(docs.where(~languages.held_out(docs["doc_id"])))
    got = {r.doc_id: r for r in languages.identify(docs, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80))
    assert [x["lang"] for x in got[200].langs] == ["de", "en"] and 0.35 < got[200].score < 0.65
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (201, 202, 203)) and got[204].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = languages.train(docs.limit(0))
    assert {r.lang_pred for r in languages.identify(docs, empty).collect()} == {"und"}
    assert languages.identify(docs.limit(0), model).count() == 0


def test_mixture_is_plain_expectation_maximisation(spark):
    rng = random.Random(7)
    say = lambda pool, n: " ".join(rng.choice(pool.split()) for _ in range(n))
    third = "voor een het van niet zijn worden maar ook meer naar door over tegen onder tussen zonder omdat toen waar"
    pools = {"de": GERMAN, "en": ENGLISH, "nl": third}
    rows = [(i, say(pools[k], 40), k, None) for i, k in enumerate(["de", "en", "nl"] * 20)]
    model = languages.train(table(spark, rows))
    samples = [say(ENGLISH, 80), f"{say(ENGLISH, 60)} {say(GERMAN, 60)}", f"{say(third, 50)} {say(GERMAN, 50)} {say(ENGLISH, 50)}", "ab", "", say(third, 3000)]
    t = next(texts(pa.array(samples), 1 << 62))
    got, some = languages.infer(t, model, 2.0)
    assert some.tolist() == [0, 1, 2, 3, 5]
    g, offs = languages.grams(t)
    for r in some:
        own = languages.bucket(g[offs[r] : offs[r + 1]], model.log.shape[0])
        units = [[float(model.log[own[i : i + languages.UNIT], k].sum()) for k in range(3)] for i in range(0, len(own), languages.UNIT)]

        def em(allowed):
            theta = {k: 1 / len(allowed) for k in allowed}
            for _ in range(12):
                total = dict.fromkeys(allowed, 0.0)
                for u in units:
                    high = max(u[k] for k in allowed)
                    p = {k: theta[k] * np.exp(u[k] - high) for k in allowed}
                    for k in allowed:
                        total[k] += p[k] / sum(p.values())
                theta = {k: total[k] / len(units) for k in allowed}
            return theta, sum(np.log(sum(theta[k] * np.exp(u[k] - max(u)) for k in allowed)) + max(u) for u in units)

        alone = [sum(u[k] for u in units) for k in range(3)]
        best = max(range(3), key=lambda k: alone[k])
        score, chosen = alone[best], {best: 1.0}
        full = em(range(3))[0]
        order = sorted(range(3), key=lambda k: -full[k])
        for size in (2, 3):
            theta, like = em(order[:size])
            if like - (size - 1) * 2.0 * np.log(len(units) + 1) <= score:
                break
            score, chosen = like - (size - 1) * 2.0 * np.log(len(units) + 1), theta
        assert [got[r, k] for k in range(3)] == pytest.approx([chosen.get(k, 0.0) for k in range(3)], abs=1e-3)
    assert (got[1] > 0.2).sum() == 2 and (got[2] > 0.2).sum() == 3
    wide = table(spark, [*rows, *rows, (900, "x" * 300_000, None, None)])  # repeated rows and a long text
    assert Counter(r.lang_pred for r in languages.identify(wide, model).where("doc_id < 900").collect()) == {"de": 40, "en": 40, "nl": 40}


def kneser_ney(text_list, order):
    """A direct transcription of the definition, with dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in text_list:
        b = bytes(order - 1) + t.encode()
        for i in range(order - 1, len(b)):
            grams[order][b[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    cut = {n: language_model.discounts(Counter(grams[n].values())) for n in range(1, order + 1)}

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        total = sum(c for x, c in grams[n].items() if x[:-1] == g[:-1])
        if not total:
            return p(g[1:])
        d = lambda c: cut[n][min(c, 3) - 1] if c else 0
        mass = sum(d(c) for x, c in grams[n].items() if x[:-1] == g[:-1])
        return (grams[n][g] - d(grams[n][g])) / total + mass / total * p(g[1:])

    return p


def test_kneser_ney_model(spark):
    train = ["the cat sat on the mat", "the dog sat", "a cat, a dog: thé", "on the mat the cat"]
    model = language_model.train(spark.createDataFrame([(t,) for t in train], "text string"), 3)
    packed = language_model.pack(model)
    p = kneser_ney(train, 3)
    query = ["the mat", "zebra the", "thé dog", ""]
    docs = spark.createDataFrame([(i, q) for i, q in enumerate(query)], "doc_id long, _text string")
    want = [sum(np.log2(p((bytes(2) + q.encode())[i : i + 3])) for i in range(len(q.encode()))) for q in query]
    for got in (language_model.score(docs, packed, ["doc_id"], 3), language_model.score_sharded(docs, model, ["doc_id"], 3)):
        assert [r.log2_prob for r in got.orderBy("doc_id").collect()] == pytest.approx(want, rel=1e-5)
    context = b"th"
    assert sum(p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_quality_classifier(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(ENGLISH.split()) for _ in range(n))
    rows = [(i, say(60), "en", None) for i in range(150)] + [(500, "".join(chr(rng.randint(33, 126)) for _ in range(300)), "en", None), (501, None, "en", None), (502, "", None, None), (None, say(50), "en", None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(500, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    got = language_model.classify(docs, labels, min_calibration=10, keep=("text", "source")).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and not kept[500] and kept[501] and kept[502]
    assert sum(kept[i] for i in range(150)) >= 147
    monkeypatch.setattr(language_model, "BROADCAST_IDS", 0)
    monkeypatch.setattr(language_model, "BROADCAST_ENTRIES", 0)
    other = language_model.classify(docs, labels, min_calibration=10).collect()
    plain = lambda rows: sorted((r.doc_id or -1, r.n_symbols, r.log2_prob, r.perplexity, r.threshold, r.worst_bits, r.worst_threshold, r.kept) for r in rows)
    assert plain(other) == plain(got)
    from notewright.llm import _shared

    monkeypatch.setattr(_shared, "BROADCAST_KEYS", 0)  # the limits joined by salted keys
    assert plain(language_model.classify(docs, labels, min_calibration=10).collect()) == plain(got)
    monkeypatch.undo()
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string")).unionByName(docs.limit(1).selectExpr("'no number' doc_id", "text", "lang", "source", "n_chars", "tokens", "_id", "size"))
    assert len(language_model.classify(named, labels, min_calibration=10).collect()) == len(rows) + 1
    long = table(spark, [*rows, (700, say(150_000), "en", None), (701, say(150_000), "xx", None)])
    got = {r.doc_id: r for r in language_model.classify(long, labels, min_calibration=10).collect()}
    assert got[700].n_symbols == len(long.where("doc_id = 700").first()["text"]) and got[701].threshold == pytest.approx(got[502].threshold)
    assert all(r.kept for r in language_model.classify(docs, labels.limit(0)).collect())
    assert language_model.classify(table(spark, []), labels).count() == 0


def test_quality_classifier_catches_a_few_bad_words(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(ENGLISH.split()) for _ in range(n))
    rows = [(i, say(60), "en", None) for i in range(500)] + [(1000 + i, f"{say(300)} zxqkjvwq {say(300)}", "en", None) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    got = language_model.classify(docs, labels, min_calibration=10).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[1000 + i] for i in range(20)) and sum(kept[i] for i in range(400, 500)) >= 85
    assert all(r.perplexity <= 1.1 * r.threshold for r in got if r.doc_id >= 1000)  # on the whole they look well
    monkeypatch.setattr(language_model, "BROADCAST_ENTRIES", 0)
    other = language_model.classify(docs, labels, min_calibration=10).collect()
    assert sorted(other) == sorted(got)  # to the bit
    prefix = -np.cumsum([0.0, 1, 2, 3, 9, 1, 5, 5])
    assert language_model.worst_windows(prefix, np.array([0, 4, 4, 5, 7]), 2).tolist() == [6, 0, 1, 5]


def test_chat_round_trip(spark):
    rows = [
        (1, 0, 0, "message", "system", "be \\ kind"), (1, 1, 0, "message", "user", "### user:\n</turn>\n#h \\h \\b<"), (1, 2, 0, "message", "assistant", "\\"), (1, 3, 0, "message", "assistant", "</turn>"),
        (2, 0, 0, "message", None, None), (2, 1, 0, "message", "ro:le\n#x", ""), (2, 1, 0, "message", "ro:le\n#x", ""), (3, 0, 0, "message", "assistant", "a" * 300_000),
        (4, 0, 0, "message", "user", "hi"), (4, 1, 0, "message", "assistant", "dra"), (4, 1, 1, "delta", None, "ft"), (4, 1, 2, "regenerate", None, "new"), (4, 1, 3, "delta", None, " text"),
        (5, 0, 0, "message", "user", "typo"), (5, 0, 1, "edit", "user", "fixed"), (5, 1, 0, "delta", "assistant", "lone"), (None, 0, 0, "message", "user", "nobody"),
    ]
    events = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, seq long, event string, role string, text string, place string")
    want = {
        1: [(r[4], r[5]) for r in rows[:4]], 2: [("", ""), ("ro:le\n#x", ""), ("ro:le\n#x", "")], 3: [("assistant", "a" * 300_000)],
        4: [("user", "hi"), ("assistant", "new text")], 5: [("user", "fixed"), ("assistant", "lone")], None: [("user", "nobody")],
    }
    rendered = chat.render(chat.fold(events))
    read = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert {k: [(t["role"], t["text"]) for t in r.turns] for k, r in read.items()} == want
    assert {k: r.loss_text for k, r in read.items()} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}
    plan = chat.digest(chat.read_back(rendered))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert chat.digest(chat.read_back(chat.render(chat.fold(events.limit(0))))).count() == 0


def test_token_attribution(spark, corpus):
    import tiktoken

    ranks = token_counts.read_ranks(token_counts.VOCABULARY)
    enc = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, corpus)
    whole = {t: [len(x) for x in enc.decode_tokens_bytes(enc.encode_ordinary(t))] for _, t, _, _ in corpus if t}
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(docs, rule=rule).collect()
        assert len(got) == len(corpus)
        want = Counter()
        for i, t, _, _ in corpus:
            lines = re.findall(rb"[^\n]*\n|[^\n]+", (t or "").encode())
            ends = np.cumsum([0, *map(len, lines)]).tolist()
            if len(lines) < 500:
                want[i, tuple(round(x, 6) for x in slow.attributed(t, whole.get(t, []), list(zip(ends[:-1], ends[1:])), rule))] += 1
        assert Counter((r.doc_id, tuple(round(x, 6) for x in r.section_tokens)) for r in got if len(r.section_tokens) < 500) == want
        for r in got:
            assert sum(r.section_tokens) == pytest.approx(r.n_tokens)
    want = Counter((i, len(enc.encode_ordinary(t or ""))) for i, t, _, _ in corpus)
    assert want == Counter((r.doc_id, r.n_tokens) for r in got)
    assert max(len(t or "") for _, t, _, _ in corpus) > token_counts.PIECE
    mixed = "".join(rng_.choice([" ", "\n", "word", "é1", "!?", "'s", "   "]) for rng_ in [random.Random(4)] for _ in range(60_000))
    assert [x for p in token_counts.pieces(mixed) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(mixed)
    assert "".join(token_counts.pieces("x" * 200_000)) == "x" * 200_000
    t = next(texts(pa.array(["ab\n\ncd été"])))
    ends = np.array([2, 5, 6, 12])  # ab | \n\nc | d |  été
    begin, end, first = token_counts.line_sections(t)
    assert first.tolist() == [0, 3] and begin.tolist() == [0, 3, 4]
    for rule, total in (("start", [2, 0, 2]), ("largest", [2, 0, 2]), ("share", [1 + 1 / 3, 1 / 3, 2 + 1 / 3])):
        assert token_counts.attribute(ends, begin, end, rule)[0].tolist() == pytest.approx(total)

    def one_by_one(ends, begin, end, rule):
        out = np.zeros(len(begin))
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
            part = np.maximum(0, np.minimum(end, b) - np.maximum(begin, a))
            if part.sum() and rule == "share":
                out += part / (b - a)
            elif part.sum() and rule == "largest":
                out[part.argmax()] += 1
            elif part.sum():
                out[(begin <= a) & (a < end)] += 1
        return out

    rng = np.random.default_rng(6)
    for _ in range(60):
        ends, cuts = np.unique(rng.integers(1, 60, 12)), np.unique(rng.integers(0, 60, 14))
        begin, end = cuts[:-1:2], cuts[1::2][: len(cuts[:-1:2])]
        for rule in token_counts.RULES:
            assert token_counts.attribute(ends, begin, end, rule)[0].tolist() == pytest.approx(one_by_one(ends, begin, end, rule).tolist())
    by = token_counts.count_tokens(docs, by="sentences").collect()
    assert sum(r.n_crossing for r in by) > 100 and all(sum(r.section_tokens) + r.n_outside == r.n_tokens for r in by)
    given = docs.limit(1).selectExpr("5L doc_id", "'ab été cd' text", "array(struct(0 as start, 4 as end), struct(4 as start, 6 as end), struct(5 as start, 99 as end)) as s")
    row = token_counts.count_tokens(given, sections="s").first()
    assert len(row.section_tokens) == 3 and row.n_outside == 0
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_long_stretches_without_white_space_are_encoded_whole(spark, monkeypatch):
    import tiktoken

    enc = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(token_counts.VOCABULARY), special_tokens={})
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghij") for _ in range(150_000))
    commas = ",".join(letters[i : i + 7] for i in range(0, len(letters), 7))
    long = [letters, commas, f"ab {letters} cd {commas} ef", " " * 150_000 + "x", "y" + "\n" * 150_000 + letters, f"{letters} ", "!\x1c?\x1f" * 40_000]
    for t in long:
        assert [x for p in token_counts.pieces(t) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    got = token_counts.count_tokens(table(spark, [(i, t, "en", None) for i, t in enumerate(long)])).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(long)}
    assert len(list(token_counts.pieces(long[2]))) > 2
    blank = "a" + " " * 2_000_000 + "b"  # encoded whole, it exhausts the encoder's stack
    assert [len(p) for p in token_counts.pieces(blank)][-2:] == [1_999_999, 2] and sum(len(enc.encode_ordinary(p)) for p in token_counts.pieces(blank)) > 2
    for _ in range(200):
        t = "".join(rng.choice([" ", "\n", "\t", "\u3000", "\x85", "\x1c", "a", "é", "!", "7", "'s"]) for _ in range(rng.randint(1, 300)))
        monkeypatch.setattr(token_counts, "PIECE", rng.randint(1, 9))
        assert [x for p in token_counts.pieces(t) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_license_scan(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"]
    rows = [
        (1, f"Some words before.\n{apache[0]}\nand after été", None, None), (2, apache[1].replace("file", "thing"), None, None), (3, "nothing to see here at all", None, None),
        (4, None, None, None), (5, "", None, None), (6, "é " + license_scan.TEMPLATES["MIT"][0] + " " + license_scan.TEMPLATES["CC-BY-NC-4.0"][0], None, None), (7, "Licensed under", None, None),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert [m["license"] for m in got[1].matches] == ["Apache-2.0"] and rows[0][1][got[1].matches[0]["start"] : got[1].matches[0]["end"]] == apache[0].rstrip(".")
    assert [m["license"] for m in got[2].matches] == ["Apache-2.0"] and 0.9 < got[2].matches[0]["coverage"] < 1 and got[2].matches[0]["matched"] > 25
    assert [m["license"] for m in got[6].matches] == ["MIT", "CC-BY-NC-4.0"]
    assert all(not got[i].matches for i in (3, 4, 5, 7))
    assert license_scan.scan_licenses(table(spark, [])).count() == 0
    a, b = (np.array(list(x.encode())) for x in ("abcdefgh", "xxabcXdefhyy"))
    assert [x.tolist() for x in license_scan.align(a, b, np.array([0]), np.array([12]), np.array([2]))] == [[7], [2], [10]]
    full = license_scan.TEMPLATES["BSD-3-Clause"][0]
    rows = [(i, t, None, None) for i, t in enumerate([full, full, f"{full} {full}", "x " * 30_000 + full, full.replace("Neither", "Not even")])]
    got = {r.doc_id: [m["license"] for m in r.matches] for r in license_scan.scan_licenses(table(spark, rows + rows[:1])).collect()}
    assert got == {0: ["BSD-3-Clause"], 1: ["BSD-3-Clause"], 2: ["BSD-3-Clause"] * 2, 3: ["BSD-3-Clause"], 4: ["BSD-3-Clause"]}


def test_alignment_is_the_cell_by_cell_one():
    def cell_by_cell(template, words, first, last, shift, band):
        width = 2 * band + 1
        score, step = defaultdict(int), defaultdict(int)
        best, at = 0, None
        for i in range(len(template)):
            for k in range(width):
                j = i + shift + k - band
                if not first <= j < last:
                    continue
                same = template[i] == words[j]
                options = [(0, 0), (score[i - 1, k] + (2 if same else -1), 1 if same else 2), ((score[i - 1, k + 1] if k + 1 < width else 0) - 1, 3), ((score[i, k - 1] if k else 0) - 1, 4)]
                score[i, k], step[i, k] = max(options, key=lambda x: x[0])
                if score[i, k] > best:
                    best, at = score[i, k], (i, k)
        if not at:
            return 0
        (i, k), matched = at, 0
        end = begin = i + shift + k - band + 1
        while i >= 0 and 0 <= k < width and step[i, k]:
            kind = step[i, k]
            if kind <= 2:
                matched += kind == 1
                begin = i + shift + k - band
                i -= 1
            elif kind == 3:
                i, k = i - 1, k + 1
            else:
                k -= 1
        return matched, begin, end

    rng = np.random.default_rng(9)
    for _ in range(60):
        words_, template = rng.integers(0, 4, 40), rng.integers(0, 4, 12)
        shift, first = rng.integers(-4, 36, 7), rng.integers(0, 10, 7)
        last = first + rng.integers(1, 30, 7)
        got = np.stack(license_scan.align(template, words_, first, last, shift, 3), 1)
        for g, *x in zip(got, first, last, shift):
            want = cell_by_cell(template, words_, *x, 3)
            assert tuple(g) == want if want else g[0] == 0


def test_winnowing_keeps_a_print_of_every_long_common_run():
    rng = random.Random(12)
    for _ in range(20):
        shared = [f"s{rng.randint(0, 5)}{i}" for i in range(license_scan.GRAM + license_scan.WINDOW - 1)]
        both = [" ".join([f"{c}{rng.random()}".replace(".", "") for _ in range(rng.randint(0, 9))] + shared + [f"{c}z{rng.random()}".replace(".", "") for _ in range(rng.randint(0, 9))]) for c in "ab"]
        prints = []
        for t in texts(pa.array(both)):
            flat, w = decontaminate.split_words(t)
            at, h = license_scan.fingerprints(w, span_hashes(flat, w.starts, w.ends))
            prints = [set(h[w.doc[at] == r].tolist()) for r in (0, 1)]
        assert prints[0] & prints[1]


def test_documents_of_null_id_are_told_apart(spark):
    """Unique texts of null ids, and of one id, stay whole; their keys are two hashes of the text."""
    shared = "this passage of some twenty words is in every second one of them. and so is this sentence of it, word by word by word."
    n = 6000
    one = [(None if i % 3 else 5, f"{shared} own{i}." if i % 2 else f"text {i} has only sentences of its own, number {i}. and {i} is in its second one too, as in no other text, whatever it is.", "en", None) for i in range(n)]
    cut = substring_dedup.remove_repeated(table(spark, one).repartition(7)).collect()
    assert len(cut) == n and all(r._nw_removed == 0 for r in cut if r.text.startswith("text "))
    assert sum(r._nw_removed == 0 for r in cut if not r.text.startswith("text ")) == 1
    keys = substring_dedup.keyed(table(spark, [(None, f"t{i}", None, None) for i in range(100_000)] + [(-(2**62), "t0", None, None)]))
    got = keys.selectExpr("count(distinct _nw_id) as a", "count(distinct _nw_th) as b", "max(_nw_id) as c", "max(case when doc_id is null then _nw_id end) as d", "corr(_nw_id, _nw_th) as e").first()
    assert (got.a, got.b, got.c) == (100_001, 100_000, -(2**62)) and got.d < got.c and abs(got.e) < 0.02
