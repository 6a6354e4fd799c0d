"""Slow twins of the operators: plain loops over lists of rows, by the definitions."""

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

from notewright.llm import language_model
from notewright.llm._kernel import mix
from notewright.llm.mixing import targets

BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k=5):
    w = split(lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near(texts):
    """The set of each text, and the number of its group: that of the first text in it."""
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(group[i], group[j])
            if group[i] != m or group[j] != m:
                group[i] = group[j] = m
                changed = True
    return sets, group


def hits(text, items, window=10):
    """Hit words and item ids of a text; items: (id, text)."""
    wins = defaultdict(set)
    for i, t in items:
        w = split(lower(t), BENCHMARK_WORD)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[a : a + k])].add("" if i is None else str(i))
    w = split(lower(text), BENCHMARK_WORD)
    hit, got = set(), set()
    for k in {len(x) for x in wins}:
        for a in range(len(w) - k + 1):
            if found := wins.get(tuple(w[a : a + k])):
                got |= found
                hit |= set(range(a, a + k))
    return w, hit, got


def sentence_words(text):
    """Words of each sentence, as pieces of the text, and where each begins; for texts without wide stops."""
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        gap = (text or "")[out[-1][-1][1] : m.start()] if out else ""
        if out and "\n" not in gap and text[out[-1][-1][1] - 1] not in ".!?":
            out[-1].append(m.span())
        else:
            out.append([m.span()])
    return [[lower(text[a:b]) for a, b in s] for s in out], [s[0][0] for s in out]


def without_repeated(rows):
    """(id, text) rows as (id, what is left of text, sentences, removed)."""
    order = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows})
    first, gone = {}, defaultdict(set)
    for i, t in order:
        s, _ = sentence_words(t)
        n = [len(x) for x in s]
        pairs = {(a, a) for a in range(len(s)) if n[a] >= 40}
        for a in range(len(s)):
            b = next((b for b in range(a + 1, len(s)) if sum(n[a : b + 1]) >= 20), None)
            pairs |= {(a, b)} if b else set()
            c = next((c for c in range(a - 1, -1, -1) if sum(n[c : a + 1]) >= 20), None)
            pairs |= {(c, a)} if c is not None else set()
        for a, b in sorted(pairs):
            key = tuple(w for x in s[a : b + 1] for w in x)
            if first.setdefault(key, (i, t, a)) != (i, t, a):
                gone[i, t] |= set(range(a, b + 1))
    out = []
    for i, t in rows:
        s, at = sentence_words(t)
        g = gone.get((-(2**63) if i is None else i, t or ""), set())
        keep = t
        if g:
            edges = [*at, len(t)]
            stay = [t[edges[k] : edges[k + 1]] for k in range(len(s)) if k not in g]
            keep = t[: edges[0]] + "".join(stay) if stay else ""
        out.append((i, keep, len(s), len(g)))
    return out


def seats(weights, n, most):
    have = [0] * len(weights)
    for _ in range(n):
        q = [w / (2 * h + 1) if h < m else -1 for w, h, m in zip(weights, have, most)]
        if max(q, default=-1) <= 0:
            break
        have[q.index(max(q))] += 1
    return have


def mixed(docs, weights, shard_docs=512, max_block=1024, group=1024):
    """What is taken of each doc_id of a frame of doc_id, source and text (ids once each); the deal to shards is by hashes that only Spark has."""
    deal = docs.selectExpr("doc_id", "source", "text", "xxhash64(7, doc_id, text) as o").selectExpr("*", "xxhash64(8, o) as s").toPandas()
    deal["source"] = [None if s is None or s != s else s for s in deal.source]
    names = sorted({s for s in deal.source if s is not None}) + ([None] if any(s is None for s in deal.source) else [])
    own = {s: [k == s for k in deal.source] for s in names}
    size = {k: sum(len(split(t)) for t, mine in zip(deal.text, own[k]) if mine) for k in names}
    goal = dict(zip(names, targets([size[k] for k in names], weights(names))))
    block = max(1, min(max_block, sum(size.values()) // (len(names) * 2048)))
    line = defaultdict(list)
    for i, t, s, o, h in zip(deal.doc_id, deal.text, deal.source, deal.o, deal.s):
        line[s, h % -(-sum(own[s]) // shard_docs)].append((o, i, len(split(t))))
    blocks = {k: max(1, math.floor(sum(n for *_, n in v) / block + 0.5)) if sum(n for *_, n in v) else 0 for k, v in line.items()}
    of = {k: sum(b for (s, _), b in blocks.items() if s == k) for k in names}
    wanted = [goal[k] / size[k] * of[k] if size[k] else 0.0 for k in names]
    quota = dict(zip(names, seats(wanted, round(sum(wanted)), [3 * of[k] for k in names])))
    taken = Counter()
    for s in names:
        shards = sorted(k for k in blocks if k[0] == s)
        inside = {g: [k for k in shards if k[1] // group == g] for g in sorted({k[1] // group for k in shards})}
        for keys, n in zip(inside.values(), seats([sum(blocks[k] for k in v) for v in inside.values()], quota[s], [3 * sum(blocks[k] for k in v) for v in inside.values()])):
            for k, q in zip(keys, seats([blocks[k] for k in keys], n, [3 * blocks[k] for k in keys])):
                words = [i for _, i, c in sorted(line[k]) for _ in range(c)]
                cuts = [i * len(words) // blocks[k] for i in range(blocks[k] + 1)] if blocks[k] else [0]
                salt = zlib.crc32(f"7/{'n' if s is None else 's' + s}/{k[1]}".encode())
                order = sorted(range(blocks[k]), key=lambda i: int(mix(np.array([(i << 32) ^ salt], np.uint64))[0]))  # noqa: B023
                for place, i in enumerate(order):
                    for w in words[cuts[i] : cuts[i + 1]]:
                        taken[w] += q // blocks[k] + (place < q % blocks[k])
    return {i: n for i, n in taken.items() if n}


def kneser_ney(texts, order):
    """Bits of an n-gram under the model of these texts, with dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = bytes(order - 1) + t.encode()
        grams[order].update(b[i - order + 1 : i + 1] for i in range(order - 1, len(b)))
    for n in range(order - 1, 0, -1):
        grams[n].update(g[1:] for g in grams[n + 1])
    cut = {n: language_model.discounts(Counter(grams[n].values())) for n in range(1, order + 1)}
    off = lambda n, c: cut[n][min(c, 3) - 1] if c else 0
    total, mass = defaultdict(int), defaultdict(float)
    for n in range(1, order + 1):
        for g, c in grams[n].items():
            total[g[:-1], n] += c
            mass[g[:-1], n] += off(n, c)

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        if not total[g[:-1], n]:
            return p(g[1:])
        c = grams[n][g]
        return (c - off(n, c)) / total[g[:-1], n] + mass[g[:-1], n] / total[g[:-1], n] * p(g[1:])

    return p


def quantile(values, q):
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values)) - 1)] if values else None


def kept_by_quality(docs, labels, least=100, order=language_model.ORDER):
    """doc_ids that the classifier keeps, of frames; which trusted documents are held out is by a hash that only Spark has."""
    rows = docs.selectExpr("doc_id", "lang", "text", "pmod(xxhash64(doc_id), 5) = 0 as held").collect()
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    mine = [r for r in rows if r.doc_id in trusted and r.text is not None]
    p = kneser_ney([r.text for r in mine if not r.held], order)

    def judged(t):
        b = bytes(order - 1) + (t or "").encode()
        bits = [-math.log2(p(b[i - order + 1 : i + 1])) for i in range(order - 1, len(b))]
        w = min(len(bits), language_model.WINDOW)
        return 2 ** (sum(bits) / len(bits)), max(sum(bits[i : i + w]) / w for i in range(len(bits) - w + 1))

    sample = [(r.lang, *judged(r.text)) for r in mine if r.held and r.text]
    limit = lambda s: (quantile([x for _, x, _ in s], 0.97), quantile([y for *_, y in s], 0.99))
    by = defaultdict(list)
    for s in sample:
        by[s[0]].append(s)
    limits = {k: limit(v) for k, v in by.items() if k is not None and len(v) >= least}
    pooled = limit(sample)
    # scores are rounded to steps in the operator: nothing here may be that near its limit
    out, margins = set(), []
    for r in rows:
        high, worst = limits.get(r.lang, pooled)
        if not r.text or high is None:
            out.add(r.doc_id)
            continue
        x, y = judged(r.text)
        margins.append(min(abs(x - high), abs(y - worst)) or 1)
        if x <= high * (1 + 1e-6) and y <= worst * (1 + 1e-6):
            out.add(r.doc_id)
    assert min(margins, default=1) > 1e-4
    return out


def rules(rows, common, min_words=50, repeat=50):
    """Distances of (lang, text) rows to their references; 1 where there is none."""

    def kind(c):
        if c in " \t\n\x0b\x0c\r":
            return 0
        if c in "#*$%&|<>":
            return 1
        k = unicodedata.category(c)
        return {"Ll": 2, "Lu": 3}.get(k) or {"L": 4, "M": 5, "N": 6, "P": 7}.get(k[0], 8)

    def failed(t):
        w = split(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w) < min_words or 100 * len(cover) > repeat * len(w)

    def distance(p, q):
        if not sum(p.values()):
            return 1.0
        out = 0.0
        for k in set(p) | set(q):
            x, y = p.get(k, 0) / sum(p.values()), q.get(k, 0) / sum(q.values())
            out += sum(v * math.log2(v / ((x + y) / 2)) for v in (x, y) if v) / 2
        return math.sqrt(max(0, min(1, out)))

    pools = defaultdict(lambda: (Counter(), Counter()))
    for lang, t in rows:
        if not failed(t):
            for k in {None, lang}:
                pools[k][0].update(map(kind, t))
                pools[k][1].update(lower(w) for w in split(t))
    out = []
    for lang, t in rows:
        ref = pools.get(lang) or pools.get(None)
        if ref is None:
            out.append((1.0, 1.0))
            continue
        top = [w for w, _ in sorted(ref[1].items(), key=lambda x: (-x[1], x[0]))[:common]]
        fold = lambda c: Counter({w: c[w] for w in top}) + Counter({None: sum(n for w, n in c.items() if w not in set(top))})  # noqa: E731,B023
        out.append((distance(Counter(map(kind, t or "")), ref[0]), distance(fold(Counter(lower(w) for w in split(t))), fold(ref[1]))))
    return out


def attributed(text, token_lengths, sections, rule="largest"):
    """Tokens of each section (begin, end in bytes) of a text."""
    out, at = [0.0] * len(sections), 0
    for n in token_lengths:
        part = [max(0, min(b, at + n) - max(a, at)) for a, b in sections]
        if sum(part):
            if rule == "largest":
                out[part.index(max(part))] += 1
            elif rule == "share":
                out = [x + p / n for x, p in zip(out, part)]
            else:
                for k, (a, b) in enumerate(sections):
                    out[k] += a <= at < b
        at += n
    return out
