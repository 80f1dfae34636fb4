"""URL rules, mixing and token counts against direct versions."""

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash

from riskloom.llm import mixing, urls, wordpiece


def judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    rows = [None, "", "no scheme", "http://", "http://COM/", "https://a.example.com/en/1?x#y", "http://www.example.com/en/", "http://b.www.example.com/en/z", "http://example.com/en", "x://net/fr/", "x://q.net/es/a", "x://qnet/es/a", "http://net?x=/fr/", "a://b://com/", "http://exämple.com/en/", "http://a.net/fr/", "http://a.net/fr/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(rows)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == {i: judge(u) for i, u in enumerate(rows)}
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_long_hosts(tmp_path):
    path = tmp_path / "rules"
    path.write_bytes(urls.build([*urls.RULES, ("a.b.c.d.org", "/", "block")]))
    array = urls.DigestArray(str(path))
    for host in ("a." * 100_000 + "net", "x" * 100_000, "a.b.c.d.org", "z.a.b.c.d.org", "b.c.d.org", "za.b.c.d.org", ".a.b.c.d.org", "net.", "..", "com"):
        fits = [h for h in array.suffixes(host) if h in ("com", "net", "a.b.c.d.org")]
        assert fits == [h for h in ("com", "net", "a.b.c.d.org") if host == h or host.endswith("." + h)]
        assert len(array.suffixes(host)) <= 6
    assert array.judge(["a." * 100_000 + "net"], ["/es/x"]) == (["net/es/"], ["block"])


def test_equal_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: len(s) % 2)  # nearly all keys collide
    path = tmp_path / "rules"
    path.write_bytes(urls.build([("a.com", "/", "block"), ("b.com", "/", "allow"), ("c.org", "/x", "block")]))
    array = urls.DigestArray(str(path))
    found = array.find(["a.com/", "b.com/", "c.org/x", "d.com/", "no"])
    assert (found >= 0).tolist() == [True, True, True, False, False]
    assert array.judge(["a.com", "b.com", "d.com"], ["/", "/", "/"])[1] == ["block", "allow", "allow"]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "b", "c", "d", "Z", None, "b", "b", "b"]), 9) for i in range(900)]
    docs += [(5000, None, "a", 9), (5001, " ", None, 9), (7, docs[7][1], docs[7][2], 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, target int")
    got = [tuple(r) for r in mixing.mix_documents(df).collect()]
    again = [tuple(r) for r in mixing.mix_documents(df.repartition(7)).collect()]
    assert sorted(got) == sorted(again) and len(got) == len(docs)
    total = defaultdict(int)
    for _, t, s, _ in docs:
        total[s] += size(t)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    target, everything = {}, sum(total.values())
    while True:  # fill up, reshare what is above
        free = [s for s in total if s not in target]
        left = everything - sum(target.values())
        over = [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 3 * total[s]]
        if not over:
            target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 3.0 * total[s] for s in over}
    source = {i: s for i, _, s, _ in docs}
    taken = defaultdict(int)
    for doc_id, n, of_source, goal, words in got:
        s = source[doc_id]
        assert of_source == total[s] and abs(goal - target[s]) < 1e-6
        assert words <= 3 * n and (n == 0 or words % n == 0)
        taken[s] += words
    largest = max(n for _, n, *_ in got)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in total)
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_mix_comes_near_its_target_where_ids_repeat(spark):
    for doc_id in (7, None):
        rows = [(doc_id, f"w{i} " * 30, "a") for i in range(100)] + [(1000 + i, f"v{i} " * 30, "b") for i in range(100)]
        got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        for low, high in ((0, 500), (1000, 1200)):
            some = [r for r in got if low <= (r.doc_id or 7) < high]
            assert abs(sum(r.taken for r in some) - some[0].target) <= 60


def test_mix_of_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix_documents(df).collect()} == {0}


def test_token_counts(spark):
    pieces = wordpiece.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known = {*pieces, *(bytes([b]) for b in range(256))}
    longest = max(map(len, known))

    def brute(word):
        left, n = wordpiece.MARK.encode() + word, 0
        while left:
            left = left[next(k for k in range(min(longest, len(left)), 0, -1) if left[:k] in known) :]
            n += 1
        return n

    texts = [None, "", " \n", "the and of", "the internationalisation of " * 30_000, "Überraschung naïve 日本語 😀😀", "▁▁a ▁", "x" * 3000, "same same", "same same", "in\x0bternational\tization"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count_tokens(rows, pieces).collect()}
    words = {i: [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w] for i, t in enumerate(texts)}
    assert got == {i: (len(w), sum(map(brute, w))) for i, w in words.items()}
    assert wordpiece.count_tokens(rows.limit(0), pieces).count() == 0


def test_small_automaton_pops_through_links():
    automaton = wordpiece.LongestMatch([b"abcd", b"ab", b"bc", b"cde"], b"")
    text = b"abce abcd bcde abab"
    starts, ends = np.array([0, 5, 10, 15]), np.array([4, 9, 14, 19])
    assert automaton.count(np.frombuffer(text, np.uint8), starts, ends).tolist() == [3, 1, 3, 2]  # ab|c|e  abcd  bc|d|e  ab|ab
