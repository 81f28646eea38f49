from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, topk, urls


# ---- top-k

def slow_top(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best = {}
        for i, v in ok:
            if i != q:
                for qi, qv in ok:
                    if qi == q and len(qv) == len(v):
                        s = sum(a * b for a, b in zip(qv, v, strict=True))
                        best[i] = max(s, best.get(i, s))
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def run_top(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, **how).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def vectors(seed, n=400, dims=8):
    rng = random.Random(seed)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.2)) for _ in range(dims)]) for i in range(n)]
    same = rows[3][1]
    rows = [(i, same if i % 3 == 0 else v) for i, v in rows]
    return [*rows, (1000, None), (1001, [None] * dims), (1002, [float("nan")] * dims), (1003, [float("inf")] * dims), (1004, []), (None, same), (1050, [f32(0.5)] * 3), (1051, [f32(0.25)] * 3), rows[6], rows[50]]


def test_top_k_against_brute_force(spark):
    rows = vectors(1)
    want = slow_top(rows)
    for block in (16, 64, 2048):
        assert run_top(spark, rows, block=block) == want


def test_top_k_of_few_rows_and_large_numbers(spark):
    big = [(0, [1e12, -1e12]), (50, [1e12, 1e12]), (1, [3.0, 4.0]), (100, [0.1, 0.2])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(q, r, i) for q, r, i, _ in slow_top(big)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_finite_components_beyond_a_double(spark):
    big = [(0, [1e306, 1.0]), (50, [-1e306, 2.0]), (1, [1e300, 4.0]), (2, [0.0, 0.5]), (100, [1.0, -3.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    exact = [(i, [math.floor(Fraction(256) * Fraction(x)) for x in v]) for i, v in big]
    want = []
    for q, qv in exact:
        if q % 50 == 0:
            score = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qv, v, strict=True)))) for i, v in exact if i != q}
            want += [(q, r, i) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i)), 1)]
    assert [g[:2] for g in got] == sorted(w[:2] for w in want)
    clipped = {(q, r): i for q, r, i in want}
    assert [clipped[100, r] for r in (1, 2, 3, 4)] == [i for q, _, i in got if q == 100]


def test_queries_by_another_column_and_no_setting_is_left(spark):
    before = dict(spark.conf.getAll)
    rows = [(i, [float(i % 7), float(i % 5)], i % 10 == 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, asks boolean")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, F.col("asks"), k=3).collect())
    want = []
    for q, qv, asks in rows:
        score = {i: sum(256 * a * 256 * b for a, b in zip(qv, v, strict=True)) for i, v, _ in rows if i != q}
        want += [(q, r, i) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:3], 1)] if asks else []
    assert got == want
    assert dict(spark.conf.getAll) == before


def test_the_threshold_collects_all_answers_and_few_others():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 0.2, (3000, 32)))
    x[:40] = x[0] + rng.integers(-4, 5, (40, 32))  # near copies raise the cutoff
    q, lists = x[:40], topk.lists_of(32, 4)
    columns, score, fresh = topk.gathered(q, x, lists, 5)
    assert columns.shape[1] == 4 * 6  # only leaders are looked up
    cutoffs = [sorted(s[f], reverse=True)[4] for s, f in zip(score, fresh, strict=True)]
    at, found, sums = topk.collected(q, x, lists, cutoffs)
    true = q @ x.T
    assert (sums == true[at, found]).all()
    assert len(at) < 0.05 * true.size
    pairs = set(zip(at.tolist(), found.tolist(), strict=True))
    assert all((i, j) in pairs for i in range(40) for j in np.argsort(-true[i], kind="stable")[:5].tolist())


# ---- URLs

def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    path = rest[end:]
    stop = min([i for i in map(path.find, "?#") if i >= 0] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def url_rows():
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        host = rng.choice(["casino-win", "spam-farm", "river", "house-lamp", "thand", "oner"]) + rng.choice(["", str(rng.randint(1, 9))]) + ".example." + rng.choice(["net", "com", "org", "info"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randint(1, 200)}{rng.choice(['', '?q=1', '#top', '.html'])}"))
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://notexample.org/es/", "x://org", "http://com?x=/fr/", "http://a.com/FR/", "http://ü.org/é\n?", "http://a.com/fr/://b/", "://org/"]
    return [*rows, *((5000 + i, u) for i, u in enumerate(odd)), (None, "http://river.example.net/a"), rows[4]]


def test_urls_against_brute_force(spark):
    rows = url_rows()
    df = spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id long, url string, host string")
    got = urls.judged(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    for i, u in rows:
        host, path = slow_parts(u)
        rule, verdict = slow_rule(host, path)
        for r in by[i]:
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
            assert verdict is None or r["verdict"] == verdict
    free = [(r, "spam" in r["host"] or "casino" in r["host"]) for r in got if r["rule"] is None and r["host"]]
    assert sum((r["verdict"] == "block") == bad for r, bad in free) / len(free) > 0.97
    assert all(r["verdict"] == "allow" and r["score"] == 0 for r in got if not r["host"] and r["page_id"] in (5000, 5001))


def slow_model(urls_with_labels):
    """Two models as functions of (context string, symbol): plain dictionaries of contexts of any length."""
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for s, y in urls_with_labels:
        for k in range(urls.ORDER, len(s)):
            for order in range(urls.ORDER + 1):
                counts[y][s[k - order : k]][s[k]] += 1
    totals = Counter()
    for y in (0, 1):
        for c, n in counts[y].items():
            totals[c] += sum(n.values())
    key = lambda c: urls.context_key(len(c), sum(x * urls.N**i for i, x in enumerate(reversed(c))))
    some = sorted((c for c in totals if len(c) >= 3 and totals[c] >= urls.LEAST), key=lambda c: (-totals[c], key(c)))[: urls.CONTEXTS]
    kept = set()

    def p(y, context, symbol):
        c = context[-2:]
        for order in range(urls.ORDER, 2, -1):
            if len(context) >= order and context[-order:] in kept:
                c = context[-order:]
                break
        return own(y, c, symbol)

    def own(y, c, symbol):
        n = counts[y].get(c, Counter())
        total = sum(n.values())
        if not c:
            return (n[symbol] + len(n) / urls.N) / (total + len(n))
        under = own(y, c[1:], symbol) if len(c) <= 2 else p(y, c[1:], symbol)
        return (n[symbol] + len(n) * under) / (total + len(n)) if total else under

    for c in sorted(some, key=key):
        gain = cost = 0.0
        for y in (0, 1):
            n = counts[y].get(c, Counter())
            gain += sum(k * math.log(own(y, c, x) / p(y, c[1:], x)) for x, k in n.items())
            cost += 0.5 * len(n) * math.log(sum(n.values())) if n else 0
        if gain > cost:
            kept.add(c)
    return p, kept


def test_url_scores_and_verdicts_against_brute_force(spark, monkeypatch):
    rows = [(i, u) for i, u in url_rows()[:900]]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged(df).collect()}

    def code(c):
        c = c.lower()
        return ord(c) - 97 if "a" <= c <= "z" else {".": urls.DOT, "-": urls.DASH, "/": urls.SLASH}.get(c, urls.DIGIT if c.isdigit() else urls.REST)

    held = {r["page_id"]: r["h"] for r in spark.createDataFrame([(i, slow_parts(u)[0]) for i, u in rows], "page_id long, host string").select("page_id", (F.pmod(F.xxhash64("host"), F.lit(urls.FOLDS)) == 0).alias("h")).collect()}
    syms, label = {}, {}
    for i, u in rows:
        syms[i] = tuple([urls.EDGE] * urls.ORDER + [code(c) for c in u] + [urls.EDGE])
        host, path = slow_parts(u)
        label[i] = 1 if any(m in host for m in urls.MARKERS) else None if slow_rule(host, path)[1] == "block" or not host else 0
    p, kept = slow_model([(syms[i], label[i]) for i, _ in rows if label[i] is not None and not held[i]])
    assert {3, 4} <= {len(c) for c in kept}
    score = {}
    for i, _ in rows:
        s = syms[i]
        score[i] = sum(math.log(p(1, s[k - 5 : k], s[k]) / p(0, s[k - 5 : k], s[k])) for k in range(5, len(s))) / (len(s) - 5)
        assert abs(got[i]["score"] - score[i]) < 1e-5
    errors = lambda t: sum(score[i] <= t for i in bad) / len(bad) + sum(score[i] > t for i in good) / len(good)
    bad, good = ([i for i, _ in rows if held[i] and label[i] == y] for y in (1, 0))
    free = [i for i, _ in rows if got[i]["rule"] is None]
    top = max((score[i] for i in free if got[i]["verdict"] == "allow"), default=-9.0)
    low = min(score[i] for i in free if got[i]["verdict"] == "block")
    assert top < low and errors((top + low) / 2) <= min(errors(t) for t in score.values()) + 0.03


def test_every_key_has_one_of_two_places():
    rng = random.Random(6)
    for n in (0, 1, 5, 4096):
        keys = rng.sample(range(32**3, 2 * 32**5), n)
        bits, slots = urls.two_places(keys)
        assert sorted(k for k in slots if k >= 0) == sorted(keys) and all(slots[at] in (-1,) or at in (urls.place(slots[at], 0, bits), urls.place(slots[at], 1, bits)) for at in range(len(slots)))


def test_urls_without_markers_are_allowed(spark):
    df = spark.createDataFrame([(1, "http://a.example.net/x"), (2, "http://b.example.org/es/y")], "page_id long, url string")
    assert {r["page_id"]: (r["verdict"], r["score"]) for r in urls.judged(df).collect()} == {1: ("allow", 0.0), 2: ("block", 0.0)}


def test_urls_native_and_empty(spark):
    df = spark.createDataFrame(url_rows()[:50], "page_id long, url string")
    out = urls.judged(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "MapInArrow", "MapInPandas"))
    assert urls.judged(df.limit(0)).count() == 0


# ---- mixing

def mix_rows(n=4000):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["apple", "green", "north", "tall"]) for _ in range(rng.randint(5, 60))), rng.choice(["en"] * 6 + ["de", "fr", "es"]), rng.choice(["s0"] * 5 + ["s1", "s2", "s3"])) for i in range(n)]
    return [*rows, (90001, None, "en", "s0"), (90002, "", "xx", None), (None, "apple pie", None, "s1"), (90003, "1 2 3", "en", "s0"), (90004, "word " * 50_000, "en", "s1"), rows[5]]


def test_weights_meet_all_margins(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, weight double")
    got = mixing.sampling_plan(df).collect()
    assert len(got) == len(rows)
    tokens = [len((t or "").split()) for _, t, _, _ in rows]
    assert sorted(r["n_tokens"] for r in got) == sorted(tokens)
    whole = sum(r["n_tokens"] * r["weight"] for r in got)
    assert abs(whole / sum(tokens) - 1) < 1e-4
    by = defaultdict(Counter)
    plain = defaultdict(Counter)
    for r in got:
        lang = r["lang"] if r["lang"] in mixing.LANGS else "other"
        for k in (("lang", lang), ("source", r["source"]), ("topic", r["topic"])):
            by[k[0]][k[1]] += r["n_tokens"] * r["weight"] / whole
            plain[k[0]][k[1]] += r["n_tokens"]
    wanted = {k: v for k, v in mixing.LANGS.items() if plain["lang"][k]}
    assert all(abs(by["lang"][k] - v / sum(wanted.values())) < 1e-4 for k, v in wanted.items())
    for name in ("source", "topic"):
        powers = {k: n**mixing.TEMPER for k, n in plain[name].items() if n}
        assert all(abs(by[name][k] - p / sum(powers.values())) < 1e-4 for k, p in powers.items())
    kept = sum(r["n_tokens"] * r["probability"] for r in got)
    assert abs(kept / sum(tokens) - mixing.FRACTION) < 0.01
    small = [r for r in got if r["n_tokens"] < 1000]
    assert abs(sum(r["sampled"] for r in small) - sum(r["probability"] for r in small)) < 4 * math.sqrt(len(small)) / 2


def slow_rake(rows):
    """Plain proportional fitting of all cells, and the rate by bisection over documents."""
    cells, docs = defaultdict(float), []
    for _, t, lang, source in rows:
        words = [w[0].lower() for w in (t or "").split()]
        groups = Counter(k + 1 for w in words for k, letters in enumerate(mixing.TOPICS) if w in letters)
        topic = min((-n, k) for k, n in groups.items())[1] if groups else 0
        cell = (source, lang if lang in mixing.LANGS else "other", topic)
        docs.append((cell, len(words)))
        cells[cell] += len(words)
    total = sum(cells.values())
    sums = [Counter(), Counter(), Counter()]
    for cell, n in cells.items():
        for k in range(3):
            sums[k][cell[k]] += n
    targets = []
    for k, s in enumerate(sums):
        raw = {v: (mixing.LANGS[v] if k == 1 else n**mixing.TEMPER) for v, n in s.items() if n}
        targets.append({v: x / sum(raw.values()) for v, x in raw.items()})
    weight = {c: 1.0 for c in cells}
    for _ in range(500):
        for k in range(3):
            now = Counter()
            for c, n in cells.items():
                now[c[k]] += n * weight[c] / total
            weight = {c: w * targets[k].get(c[k], 0) / now[c[k]] if now[c[k]] else w for c, w in weight.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        rate = (low + high) / 2
        kept = sum(n * min(1, rate * weight[c]) for c, n in docs)
        low, high = (rate, high) if kept < mixing.FRACTION * total else (low, rate)
    return [(weight[c], min(1, rate * weight[c])) for c, _ in docs], targets


def test_plan_against_brute_force(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(mix_rows(1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want, _ = slow_rake(rows)
    got = {r["doc_id"]: r for r in mixing.sampling_plan(df).collect()}
    for (i, t, *_), (weight, probability) in zip(rows, want, strict=True):
        if (t or "").split():
            assert abs(got[i]["weight"] - weight) < 1e-4 * weight and abs(got[i]["probability"] - probability) < 0.02 * probability, i


def test_margins_of_the_sample(spark):
    """Of the drawn documents, weighted by weight / probability, the margins are the targets."""
    rows = [(i, *r[1:]) for i, r in enumerate(mix_rows(8000))]
    _, targets = slow_rake(rows)
    got = [r for r in mixing.sampling_plan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r["n_tokens"] < 1000]
    left = [r for r in mixing.sampling_plan(spark.createDataFrame([r for r in rows if len(r[1] or "") < 9000], "doc_id long, text string, lang string, source string")).collect() if r["sampled"] and r["n_tokens"]]
    whole = sum(r["n_tokens"] * r["weight"] / r["probability"] for r in left)
    assert len(got) > 7900
    lang = Counter()
    for r in left:
        lang[r["lang"] if r["lang"] in mixing.LANGS else "other"] += r["n_tokens"] * r["weight"] / r["probability"] / whole
    assert all(abs(lang[k] - v) < 0.03 for k, v in targets[1].items() if v > 0.02)


def test_a_topic_column_and_impossible_targets(spark):
    rows = [(i, "word " * 10, "en", "s", k) for i, k in enumerate([1, 1, 1, 2, None, 99, -1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind int")
    assert sorted(r["topic"] for r in mixing.sampling_plan(df, topic="kind").collect()) == [0, 0, 0, 1, 1, 1, 2]
    tied = spark.createDataFrame([(1, "word " * 10, "en", "s", 1), (2, "word " * 10, "de", "t", 2)], "doc_id long, text string, lang string, source string, kind int")
    with pytest.warns(UserWarning, match="raking"):
        assert mixing.sampling_plan(tied, topic="kind").count() == 2


def test_mixed_keeps_columns_and_agrees_with_the_plan(spark):
    df = spark.createDataFrame([(*r, 1.0, 2, "x", None) for r in mix_rows(500)], "doc_id long, text string, lang string, source string, weight double, mix_topic int, a string, doc string").withColumn("tokens", F.lit(3))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    plan = {r["doc_id"] for r in mixing.sampling_plan(df).collect() if r["sampled"]}
    assert {r["doc_id"] for r in out.collect()} == plan
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.sampling_plan(df.limit(0)).count() == 0


def test_many_sources_use_a_join(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1.0) for r in mix_rows(300)], "doc_id long, text string, lang string, source string, weight double")
    few = sorted(map(str, mixing.sampling_plan(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(map(str, mixing.sampling_plan(df).collect())) == few


def test_repeated_words_of_topics(spark):
    df = spark.createDataFrame([(1, "apple bear north"), (2, "émile 12"), (3, "Zulu\tvery\nNorth")], "doc_id long, text string")
    got = {r["doc"]["doc_id"]: (r["tokens"], r["topic"]) for r in mixing.measured(df).collect()}
    assert got == {1: (3, 1), 2: (2, 0), 3: (3, 4)}


def test_contexts_beyond_the_literals_are_kept(spark, monkeypatch):
    df = spark.createDataFrame([*url_rows()[:900], (None, None), (7, ""), (7, "")], "page_id long, url string")
    few = sorted(map(tuple, urls.judged(df).collect()), key=str)
    monkeypatch.setattr(urls, "CONTEXTS", 3)
    assert isinstance(urls.ratios(df.select(urls.symbols(F.col("url")).alias("s"), (F.col("page_id") % 2).cast("int").alias("label"))), urls.RatioTable)
    many = sorted(map(tuple, urls.judged(df).collect()), key=str)
    assert len({r[5] for r in few}) > 100
    assert [r[:5] for r in many] == [r[:5] for r in few]
    assert all(abs(a[5] - b[5]) <= 2e-6 for a, b in zip(many, few, strict=True))
