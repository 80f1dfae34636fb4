"""The trained operators on held-out rows, and their defined cases."""

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import langid, maxent, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(10**7, None, "en", "x"), (10**7 + 1, "", "en", "x"), (10**7 + 2, " 12 34 !! ", None, None), (10**7 + 3, "ab " * 400_000, "fr", None), (10**7 + 4, "q", "de", "x"), (10**7 + 4, "q", "de", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    return given.union(spark.createDataFrame(EDGES, given.schema)).withColumn("score", F.lit("clash")).cache()


def test_language(spark, docs):
    profiles = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(docs, profiles).withColumn("held_out", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held_out and r.doc_id < 10**7]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (10**7, 10**7 + 1, 10**7 + 2)} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert langid.identify(docs.limit(0), profiles).count() == 0
    nothing = langid.learn(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(docs.limit(5), nothing).collect()} == {"und"}


LONG_TEXTS = ["the quick brown fox, élan vital. " * 50, "x" * 700 + " y", "ab" * 300, "e\u0301" * 200 + "...", " ,;" * 300 + "a", "\u0301" * 400, "ΟΔΟΣ.ΟΔΟΣ " * 30 + "İstanbul" * 40, "日本語 テキスト" * 60 + "12 34"]


@pytest.mark.parametrize("run", [7, 10, 64, 333])
def test_long_texts_are_counted_as_short_ones(monkeypatch, run):
    for text in LONG_TEXTS:
        monkeypatch.setattr(langid, "RUN", 10**6)
        whole = dict(zip(*map(list, next(langid.counted([text]))), strict=True))
        monkeypatch.setattr(langid, "RUN", run)
        assert dict(zip(*map(list, next(langid.counted([text]))), strict=True)) == whole


def plain_grams(text):
    """N-grams of one to three characters by a direct loop: gaps are one space, and each n-gram has a letter or mark at its
    heart (a pair: on either side)."""
    chars = [" "]
    for c in text.lower():
        if unicodedata.category(c)[0] in "LM":
            chars.append(c)
        elif chars[-1] != " ":
            chars.append(" ")
    if not any(unicodedata.category(c)[0] == "L" for c in chars):
        return Counter()
    if chars[-1] != " ":
        chars.append(" ")
    found = Counter(c for c in chars if c != " ")
    found.update(a + b for a, b in zip(chars, chars[1:], strict=False))
    found.update(a + b + c for a, b, c in zip(chars, chars[1:], chars[2:], strict=False) if b != " ")
    return found


def plain_order(counts, size):
    key = lambda g: langid._gram(*(0 if c == " " else ord(c) for c in g))  # noqa: E731  (ties have no other order)
    return sorted(counts, key=lambda g: (-counts[g], key(g)))[:size]


def test_profiles_and_distances_against_plain_loops(spark, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:120] + [(9001, "", "en"), (9002, "12", "en"), (9003, "e\u0301a " * 30, "xx"), (9004, None, "en")]
    size = 60
    totals = defaultdict(Counter)
    for _, text, lang in rows:
        if lang is not None:
            totals[lang].update(plain_grams(text or ""))
    ranks = {lang: {g: i for i, g in enumerate(plain_order(c, size))} for lang, c in totals.items() if c}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.learn(df, size)).collect()}
    for i, text, _ in rows:
        mine = plain_order(plain_grams(text or ""), size)
        if not mine:
            assert got[i] == ("und", 0.0)
            continue
        distance = {lang: sum(abs(p[g] - n) if g in p else size for n, g in enumerate(mine)) for lang, p in ranks.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[i][0] == best and abs(got[i][1] - (1 - distance[best] / (size * len(mine)))) < 1e-12


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    more = spark.createDataFrame([(10**7, 1, 1), (10**7 + 3, 1, None), (1, 1, 7), (10**8, 0, 1)], labels.schema)
    model = toxicity.fit(docs, labels.union(more))
    got = toxicity.score(docs, model).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    caught = sum(r.predicted for r in held if r.toxic)
    assert caught >= 0.85 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs.limit(3), toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_pooling_and_scores_against_plain_loops():
    rng = np.random.default_rng(2)
    model = toxicity._blank(2)
    model.bias, model.languages, model.thresholds = rng.standard_normal(24).astype(np.float32), rng.standard_normal((toxicity.WORD_ROWS, 2)).astype(np.float32), np.array([0.3, -0.2])
    texts = ["", "one", "two words", "Some more words, é and 日本 too", "!!!", "a b c d e f g h " * 5, "x" * 40]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w, h, places = toxicity.hashed_words(np.frombuffer(data, np.uint8), offsets)
    got = model.score(w, h, places)
    for t, text in enumerate(texts):
        alone = toxicity.hashed_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        mine = slice(places[t], places[t + 1])
        assert alone[0].tolist() == w[mine].tolist() and alone[1].tolist() == h[mine].tolist()
        assert len(alone[0]) == len(re.findall(r"[^\W_]+", text))
        x = [model.word[a] + model.head[b] for a, b in zip(*alone[:2], strict=True)]
        pooled = []
        for f, width in enumerate(toxicity.WIDTHS):
            for c in range(toxicity.FILTERS):
                responses = [sum(float(x[i + k] @ model.filters[f][k][:, c]) for k in range(width)) for i in range(len(x) - width + 1)]
                pooled.append(max(0.0, max(responses) + float(model.bias[f * toxicity.FILTERS + c])) if responses else 0.0)
        spoken = int(np.argmax(sum((model.languages[a].astype(float) for a in alone[0]), np.zeros(2))))
        over = sum(p * float(u) for p, u in zip(pooled, model.unit, strict=True)) + model.offset - model.thresholds[spoken]
        assert abs(got[t] - 1 / (1 + math.exp(-over) * 3 / 7)) < 1e-5


def test_toxicity_sample_is_bounded(spark):
    docs = [(7, f"text number {i} is here", "en") for i in range(900)] + [(8, "the same", "en")] * 300 + [(i, f"other words {i}", "en") for i in range(100, 400)]
    labels = [(7, 0, 1), (8, 0, 0), (8, 0, 0), *((i, 0, i % 2) for i in range(100, 400))]
    df, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.sample_of(df, known, 100).collect()
    assert 100 < len(got) < 400 and len({(r.doc_id, r.w, r.toxic) for r in got}) == len(got)


def test_toxicity_learns_from_whole_texts(spark):
    text = " ".join(f"word{i}" for i in range(50_000))
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    df = spark.createDataFrame(list(zip(ids, (text, "short", None), ("en",) * 3, strict=True)), "doc_id long, text string, lang string")
    known = spark.createDataFrame([(ids[0], 0, 1), (ids[1], 0, 0), (ids[2], 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(len(r.w) // 4 for r in toxicity.sample_of(df, known, 100).collect()) == [0, 1, 50_000]


def test_toxicity_learns_from_all_labelled_rows(spark):
    rows = [(i, f"row{i % 7} of b{i % 11} {'vile' if i % 10 == 0 else 'kind'} end", ("en", "de", None)[i % 3], int(i % 10 == 0)) for i in range(9000)]
    df, known = (spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").select(*c) for c in (("doc_id", "text", "lang"), ("doc_id", "toxic")))
    model = toxicity.fit(df, known)
    assert len([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and not r[3]]) > 5000
    seen = np.full((toxicity.WORD_ROWS, 2), 0.1)
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang:
            w = toxicity.hashed_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
            np.add.at(seen[:, ["de", "en"].index(lang)], w, 1)
    assert np.allclose(model.languages, np.log(seen / seen.sum(0)), atol=1e-5)
    assert all(r.predicted == (r.doc_id % 10 == 0) for r in toxicity.score(df, model).collect())


def test_toxicity_learns_alike_in_any_layout(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = docs.filter("doc_id < 10000000").select("doc_id", "text", "lang")
    twice = some.union(some.filter("doc_id < 200"))  # repeated rows are learned from once
    models = [toxicity.fit(some.repartition(1), labels), toxicity.fit(some.repartition(8), labels)]
    for name in ("word", "head", "unit", "thresholds"):
        assert np.allclose(getattr(models[0], name), getattr(models[1], name), atol=1e-3)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 10**6)
    assert np.allclose(toxicity.fit(some, labels).word, toxicity.fit(twice, labels).word, atol=1e-3)


def test_toxicity_rounds_shuffle_one_sum_a_core(spark, monkeypatch):
    rnd = __import__("random").Random(4)
    texts = [" ".join(f"word{rnd.randrange(3000)}" for _ in range(40)) + (" vile" if i % 8 == 0 else "") for i in range(3000)]
    rows = [(i, text, "en", int(i % 8 == 0)) for i, text in enumerate(texts)]
    df, known = (spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").select(*c) for c in (("doc_id", "text", "lang"), ("doc_id", "toxic")))
    core = spark.sparkContext._jsc.sc()

    def written():
        core.listenerBus().waitUntilEmpty(30_000)
        return core.statusStore().executorSummary("driver").totalShuffleWrite()

    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)  # ten shards
    before = written()
    model = toxicity.fit(df, known)
    assert written() - before < 10e6
    monkeypatch.setattr(toxicity, "ONE_STEP", 0)  # sums in groups first
    again = toxicity.fit(df, known)
    for name in ("word", "head", "unit", "thresholds"):
        assert np.allclose(getattr(model, name), getattr(again, name), atol=1e-3)


@pytest.mark.parametrize("rows", [3, 250_000])
def test_toxicity_thresholds_against_plain_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(toxicity, "RANGE_ROWS", rows)
    rnd = __import__("random").Random(6)
    given = [(s, rnd.randint(0, 12) / 4, int(rnd.random() < (0.1, 0.5, 0.9)[s])) for s in range(3) for _ in range(30)] + [(4, 0.5, 0), (5, 0.5, 1)]

    def plain(mine):
        values = sorted({r for r, _ in mine}, reverse=True)
        gains = [sum(2 * y - 1 for r, y in mine if r >= v) for v in values]
        if max(gains) <= 0:
            return values[0] + 1
        i = gains.index(max(gains))
        return (values[i] + values[i + 1]) / 2 if i + 1 < len(values) else values[i] - 1

    got = {r.spoken: (r.toxic, r.threshold) for r in toxicity.best_thresholds(spark.createDataFrame(given, "spoken int, response double, toxic int")).collect()}
    groups = {s: [(r, y) for t, r, y in given if s in (None, t)] for s in (None, 0, 1, 2, 4, 5)}
    assert got == {s: (sum(y for _, y in mine), plain(mine)) for s, mine in groups.items()}


def test_language_model(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x] + [None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(counts.values()), len(counts)
    got = sorted(maxent.score_documents(docs.drop("lang", "source")).collect(), key=lambda r: r.doc_id)
    for r, (i, _), t, h in zip(got, sorted(rows, key=lambda x: x[0]), [t for _, t in sorted(zip([i for i, _ in rows], tokens, strict=True), key=lambda x: x[0])], [h for _, h in sorted(zip([i for i, _ in rows], held, strict=True), key=lambda x: x[0])], strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, h, len(t), sum(counts[x] > 0 for x in t), n)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        assert abs(r.base_score - base) <= 1e-8 * abs(base) + 1e-9 and r.score < 0
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_language_model_starts_from_all_documents(spark):
    rows = [(i, f"the {i % 5} word{i % 50}" + (f" only{i}" if i < 600 else "")) for i in range(9000)]
    model = maxent._start(spark.createDataFrame(rows, "doc_id long, text string"), 1 << 14)
    words = Counter(x for _, t in rows for x in t.split())
    data = " ".join(words).encode()
    keys, classes, _ = maxent.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), model.endings)
    assert set(model.head.tolist()) == set(keys[:-1].tolist())
    of_class = np.ones(maxent.CLASSES) + np.bincount(classes[:-1], list(words.values()), maxent.CLASSES)
    of_class[maxent.END] += len(rows)
    assert np.allclose(model.tables[1][0], np.log(of_class / of_class.sum()), atol=1e-6)


def test_language_model_on_little(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.score_documents(empty).count() == 0
    one = maxent.score_documents(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert (one[0].n_tokens, one[0].train_tokens) == (1, 1)


def plain_scores(rows, model):
    """log10 probabilities by direct loops over the model's tables, and the probability of everything after one history."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [[x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    vocabulary = sorted({x for t in texts for x in t})
    data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    keys, classes, _ = maxent.tokens(data, np.array([0, len(data)]), model.endings)
    known = dict(zip([*vocabulary, None], zip(keys.tolist(), classes.tolist(), model.slots(keys)[1].tolist(), strict=True), strict=True))
    counts = Counter(x for t, h in zip(texts, held, strict=True) if not h for x in [*t, None])
    rest = {c: [x for x in vocabulary if known[x][1] == c and known[x][2] == maxent.REST] for c in range(maxent.CLASSES)}
    below = {c: sum(counts[x] for x in xs) + sum(counts[x] > 0 for x in xs) + 1 for c, xs in rest.items()}
    mask = (1 << 64) - 1

    def mixed(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * m & mask
        return x ^ (x >> 33)

    def factors(one, two, c):
        features = [one, two + 2 & mask, one * 0x9E3779B97F4A7C15 + two & mask]
        out = []
        for t, salt, bias in ((0, 0, 0), (2, (c + 1) * 0xC2B2AE3D27D4EB4F & mask, c)):
            z = model.tables[t + 1][bias].astype(float)
            for f in features:
                z = z + model.tables[t][mixed(f ^ salt) >> 20 & model.rows - 1].astype(float)
            out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        return out

    def probability(one, two, x):
        _, c, slot = known[x]
        by_class, by_slot = factors(one, two, c)
        p = by_class[c] * by_slot[slot]
        return p * (counts[x] + 1) / below[c] if slot == maxent.REST else p

    start = int(maxent._START_KEY)
    scores = []
    for t in texts:
        before, total = (start, start), 0.0
        for x in [*t, None]:
            total += math.log10(probability(*before, x))
            before = (known[x][0], before[0])
        scores.append(total)
    unknown = lambda c: (lambda f: f[0][c] * f[1][maxent.REST] / below[c])(factors(start, start, c))
    whole = sum(probability(start, start, x) for x in [*vocabulary, None] if x is None or counts[x] or known[x][2] < maxent.REST)
    return scores, whole + sum(unknown(c) for c in range(maxent.CLASSES - 1))


def test_language_model_scores_against_plain_loops(spark):
    rnd = __import__("random").Random(4)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("ing", "ed", "s", "er", "xy", "é")] + ["The", "of", "Q"]
    rows = [(i, " ".join(rnd.choice(words) if rnd.random() < 0.7 else "the of" for _ in range(rnd.randint(0, 40)))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = maxent.train(df.filter(maxent.train_row(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in maxent.score(df, model, counts).collect()}
    want, whole = plain_scores(rows, model)
    assert all(abs(got[i] - w) < 1e-3 for (i, _), w in zip(rows, want, strict=True)) and abs(whole - 1) < 1e-5


def test_language_model_learns_alike_in_any_layout(spark, docs, monkeypatch):
    monkeypatch.setattr(maxent, "SHARD_BYTES", 200_000)
    some = docs.select("doc_id", "text").filter("doc_id < 10000000")
    scores = [{r.doc_id: r.score for r in maxent.score_documents(some.repartition(n)).collect()} for n in (1, 8)]
    assert all(abs(scores[0][i] - s) <= 1e-3 + 1e-5 * abs(s) for i, s in scores[1].items())
    held = {r.doc_id: r for r in maxent.score_documents(some).collect() if r.held_out}
    assert sum(scores[0][i] for i in held) > sum(r.base_score for r in held.values())


def test_language_model_counts_a_word_once_a_task(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"text": [f"the word{i % 7} Word{i % 5} x{k}", None, ""]}) for k in range(4) for i in range(30)]
    words = Counter(x for b in batches for t in b["text"].to_pylist() for x in (t or "").lower().split())
    for held, rows in ((maxent.HELD_WORDS, len(words)), (6, None)):
        monkeypatch.setattr(maxent, "HELD_WORDS", held)
        found = [r for b in maxent.count_words(iter(batches)) for r in b.to_pylist()]
        assert rows in (None, len(found))
        got = Counter()
        for r in found:
            got[r["key"]] += r["n"]
        assert sorted(got.values()) == sorted(words.values())
        assert all(len({r["ending"] for r in found if r["key"] == k}) == 1 for k in got)


def test_language_model_steps_against_plain_loops():
    rnd = np.random.default_rng(3)
    at, d = np.minimum(rnd.geometric(0.02, (3000, 3)) - 1, 199).astype(np.int32), rnd.normal(size=(3000, 16)).astype(np.float32)
    learner = maxent.Learner(rnd.normal(size=(200, 16)).astype(np.float32))
    weights, seen = learner.weights.astype(float), learner.seen.astype(float)
    learner.update(at, d)
    for row in range(200):
        g = sum((d[i].astype(float) for i, k in np.argwhere(at == row)), np.zeros(16)) / math.sqrt(max(1, (at == row).sum()))
        seen[row] += g * g
        weights[row] -= maxent.RATE * g / np.sqrt(seen[row])
    assert np.allclose(learner.weights, weights, atol=1e-4) and np.allclose(learner.seen, seen, rtol=1e-4)
    assert (learner.touched == np.isin(np.arange(200), at)).all()


@pytest.mark.parametrize("shift", [0.0, 500.0, -500.0])
def test_language_model_probabilities_of_any_weights(shift):
    rnd = np.random.default_rng(5)
    tables = [rnd.normal(size=(50, 16)).astype(np.float32), (rnd.normal(size=(4, 16)) + shift).astype(np.float32)]
    at, y = [rnd.integers(0, 50, (300, 3)), rnd.integers(0, 4, (300, 1))], rnd.integers(0, 16, 300)
    z = tables[1][at[1][:, 0]].astype(float) + tables[0][at[0]].astype(float).sum(1)
    want = z - z.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    assert np.allclose(maxent.log_probability(tables, at, y), want[np.arange(300), y], atol=1e-3)
