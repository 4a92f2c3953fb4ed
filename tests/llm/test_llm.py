import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsieve.llm import collapse, golomb, gru, heavy, langid, leakage, lookalike, packing, seen, wikitext


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("n", [0, 1, 128, 129, 5000])
def test_golomb_round_trip(n):
    r = np.random.default_rng(n)
    v = np.unique(r.integers(0, 1 << 24, n, dtype=np.uint64))
    g = golomb.GolombSet(24, v)
    assert np.array_equal(g.values(), v)
    p = np.concatenate([v[:500], r.integers(0, 1 << 24, 500, dtype=np.uint64)])
    assert np.array_equal(g.contains(p), np.isin(p, v))
    g.decoded_blocks = 0
    g.contains(v[:1])
    assert g.decoded_blocks == min(n, 1)
    g.add(p)
    assert np.array_equal(g.values(), np.union1d(v, p))
    if n == 5000:
        assert g.size_bytes * 8 / g.n < 24


def test_seen(spark, tmp_path):
    r = random.Random(3)
    lines = [r.choice(["hot.example", "HXXP://a[.]b/c/", "http://A.B/c", " x.y. ", "x.y", "", "# no", None, f"k{r.randrange(400)}.z", f"u.z/{i}"]) for i in range(1500)]
    frame(spark, list(enumerate(lines)), "entry_id bigint, entry string").write.parquet(str(tmp_path / "blocklist_feed.parquet"))
    frame(spark, [("domain", "k7.z"), ("url", "u.z/3"), (None, "q"), ("url", None)], "kind string, entry_key string").write.parquet(str(tmp_path / "blocklist_seed.parquet"))

    def key(s):
        s = (s or "").strip()
        if not s or s[0] == "#":
            return None
        s = s.replace("HXXP", "http").replace("[.]", ".")
        return ("url", s.split("://")[-1].lower().rstrip("/")) if "/" in s else ("domain", s.lower().rstrip("."))

    known, expected = {("domain", "k7.z"), ("url", "u.z/3")}, set()
    for i, s in enumerate(lines):
        if k := key(s):
            if k in known:
                expected.add(i)
            known.add(k)
    got = [x.entry_id for x in seen.p1_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    keys = seen.feed_keys(spark, str(tmp_path))
    assert seen.probe(keys.limit(0), 0).count() == 0
    coarse, fine = seen.p1_error_rate(spark, str(tmp_path)).collect()
    assert coarse.lines == fine.lines == sum(key(s) is not None for s in lines) and fine.hits == len(expected) and fine.false_positives == 0
    assert fine.sure < fine.hits and coarse.hits - coarse.false_positives == fine.hits


def test_seen_hot_and_wrong(spark, monkeypatch):
    monkeypatch.setattr(seen, "BUCKET_KEYS", 256)
    n = 20_000
    # a third of all rows is one key; one id lies far away
    keys = spark.range(n).select(F.when(F.col("id") == n - 1, 10**15).otherwise(F.col("id")).alias("ord"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(9000)))).alias("k"))
    keys = keys.select("ord", F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), "k").alias("h2")).cache()
    first = {}
    rows = sorted(keys.collect())
    for r in rows:
        first.setdefault(r.h2, r.ord)
    got = [r.ord for r in seen.probe(keys, n).collect()]
    assert len(got) == len(set(got)) and set(got) == {r.ord for r in rows if first[r.h2] < r.ord}
    a = seen.audited(keys, n, 4).first()
    assert a.false_positives > 20 and 0.5 < a.audited_rate / a.theoretical_rate < 2 and a.hits == len(got) + a.false_positives


def test_growing_set():
    r = np.random.default_rng(1)
    g, known = golomb.GrowingSet(40), set()
    for _ in range(30):
        v = r.integers(0, 3000, r.integers(0, 400), dtype=np.uint64) * np.uint64(300_000_000)
        expected = []
        for x in v.tolist():
            expected.append(x in known)
            known.add(x)
        assert g.probe_and_add(v).tolist() == expected
    assert g.n == len(known) and len(g.parts) < 12


# ---------------------------------------------------------------- 2


def test_forms(spark):
    cases = {
        "ｆｕｌｌ　ｗ": "full w",
        "pаypаl": "paypal",
        "é": "é",
        "ệ": "ệ",
        "ệ": "ệ",
        "a​b­c": "abc",
        "​": "",
        "a b": "a b",
        "ﬁx": "fix",
        "й": "й",
        "й": "й",
        "각": "각",
        "각": "각",
        "plain": "plain",
    }
    got = {r.value: r.form for r in lookalike.forms(frame(spark, [(k,) for k in cases], "value string")).collect()}
    assert got == cases


def test_visibly_different():
    for ch in "²½①™№ªſ¨⑴㎏ẛ":
        assert lookalike.shown(ch) != unicodedata.normalize("NFKD", ch), ch
    assert [lookalike.shown(c) for c in "ａ𝖺ﬁⅴ…\u00a0\u2009µ"] == ["a", "a", "fi", "v", "...", " ", " ", "μ"]


def test_recompose_agrees_with_unicode():
    r = random.Random(0)
    chars = "aeiouzαιωяй\u0301\u0308\u0323\u0327\u0345\u0300\u0302각가x"
    for _ in range(3000):
        apart = unicodedata.normalize("NFD", "".join(r.choice(chars) for _ in range(r.randrange(9))))
        assert lookalike.recompose(apart) == unicodedata.normalize("NFC", apart)


def test_pairs(spark):
    rows = [("f", 1, "paypal"), ("f", 2, "pаypal"), ("f", 3, "paypal"), ("f", 4, "ｐaypal"), ("f", 5, None), ("f", 6, ""), ("g", 7, "pаypal"), ("f", 8, "PayPal"), ("f", 9, "pаypаl"), ("f", 10, "é"), ("f", 11, "e")]
    df = frame(spark, rows, "field string, id bigint, value string")
    got = sorted(map(tuple, lookalike.same_looking_pairs(df, hot_rows=1).collect()))
    like = {1: "p", 3: "p", 2: "q", 4: "r", 9: "s"}
    assert got == sorted(("f", a, b) for a in like for b in like if a < b and like[a] != like[b])
    assert lookalike.same_looking_pairs(df.limit(0)).count() == 0
    classes = {r.id: r.class_id for r in lookalike.same_looking_classes(df, hot_rows=1).collect()}
    assert classes == {i: 1 for i in like}
    form = lookalike.consistent(df.withColumnRenamed("field", "__x"), "value", "form").collect()
    assert {r.id: r.form for r in form}[9] == "paypal" and len(form) == len(rows)
    # a third of the rows is one look-alike value
    hot = df.unionAll(spark.range(300).select(F.lit("f"), F.col("id") + 100, F.lit("pаypаl")))
    assert lookalike.consistent(hot, "value", "form", hot_rows=10).filter("form = 'paypal'").count() == 306


# ---------------------------------------------------------------- 4


def test_frequent(spark):
    r = random.Random(5)
    values = [r.choice(["a"] * 30 + ["b"] * 10 + ["", None]) if i % 3 else f"x{i}" for i in range(6000)]
    df = frame(spark, [(v, "q") for v in values], "v string, field string").repartition(7)
    got = {x.item: x.rows for x in heavy.frequent(df.select("v"), ["v"], 0.01, k=200).collect()}
    assert got == {v: values.count(v) for v in set(values) if v is not None and values.count(v) >= 60}
    parts = heavy.merged(heavy.summaries(df.select("v"), ["v"], 50), 50).collect()
    assert len({p.part for p in parts}) == 1 and len({p.item for p in parts}) == len(parts)
    assert len(parts) <= 50 and all(0 <= values.count(p.item) - p.counter <= 6000 / 51 for p in parts)
    assert heavy.frequent(df.select("v").limit(0), ["v"], 0.01).count() == 0
    with pytest.raises(ValueError):
        heavy.frequent(df, ["v"], 0.001, k=100)


# ---------------------------------------------------------------- 5

SAME = [
    "http://a.b/c/D?x=1&y=2#f",
    "HXXP[:]//A(dot)b//c/d/?&y=2&x=1&#f#",
    " <a.b/c/d?y=2&&x=1#f>,",
    "//a.b./c/\r\n d?x=1&y=2#f;",
    '"http://a[.]b/c/d?x=1&y=2#f"',
]
OTHER = ["https://a.b/c/d?x=1&y=2#f", "http://a.b:80/c/d?x=1&y=2#f", "http://a.b/c/d?x=1&y=2", "http://a.b/c-d?x=1&y=2#f", "http://a.b/c/d?x=1&x=1&y=2#f", "http://á.b/c/d?x=1&y=2#f", "http://[2001:db8::1]", "mailto:x@y", "https:///q"]


def test_collapse(spark):
    urls = [*SAME, *OTHER, *SAME, None, "", " ,", "http://[2001:DB8::1]/"]
    df = frame(spark, [(i, u, "x") for i, u in enumerate(urls)], "n bigint, u string, id string")
    keys = collapse.keyed(collapse.canonical_url(df, "n", "u"))
    pairs = sorted(map(tuple, collapse.members(keys, hot_rows=3).collect()))
    same = [*range(1, 5), *range(14, 19)]
    assert pairs == sorted([*((0, i) for i in same), (11, 22)])
    records = {r.keep_id: r.copies for r in collapse.collapse(collapse.canonical_url(df, "n", "u")).collect()}
    assert records[0] == 10 and records[11] == 2 and sum(records.values()) == len(urls) and len(records) == len(urls) - len(pairs)
    assert collapse.collapse(collapse.canonical_url(df.limit(0), "n", "u")).count() == 0


def test_filters_agree_with_grouping(spark, monkeypatch):
    r = random.Random(2)
    texts = frame(spark, [(i, f"t{r.randrange(3000)}") for i in range(4000)], "id bigint, text string").repartition(5)
    one = sorted(map(tuple, collapse.collapse(texts).collect()))
    first, n = {}, {}
    for x in texts.collect():
        first[x.text] = min(x.id, first.get(x.text, x.id))
        n[x.text] = n.get(x.text, 0) + 1
    assert one == sorted((first[t], n[t]) for t in n)
    # many shards, a pass each; few rows pass that are no repeats
    monkeypatch.setattr(collapse, "SHARD_KEYS", 500)
    monkeypatch.setattr(collapse, "MAX_FILTER_BYTES", 1)
    assert one == sorted(map(tuple, collapse.collapse(texts).collect()))
    keys = collapse.keyed(texts)
    assert len(list(collapse.repeat_filters(keys, 8))) == 8
    passed = collapse.flagged(keys, 4000).filter("maybe").count()
    repeats = sum(k for k in n.values() if k > 1)
    assert repeats <= passed < repeats + 40


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {10: 4}, {1: 7}, {6: 5, 4: 3, 3: 1}, {s: s % 4 for s in range(1, 11)}])
def test_plan(histogram):
    plan = packing.best_plan(histogram, 10)
    load = {}
    for size, _, n, first in plan.ranges:
        for i in range(n):
            load[first + i] = load.get(first + i, 0) + size
    assert sum(load.values()) == sum(s * n for s, n in histogram.items()) and max(load.values(), default=0) <= 10
    assert sorted(load) == list(range(plan.containers))


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 7)
    r = random.Random(4)
    counts = frame(spark, [(i, r.choice([0, 3, 40, 40, 55, 99, 100, 257])) for i in range(300)], "doc_id bigint, tokens bigint")
    rows = packing.pack(packing.pieces(counts, 100), 100).collect()
    load, whole = {}, {}
    for x in rows:
        whole[x.doc_id] = whole.get(x.doc_id, 0) + x.size
        if x.size:
            load[x.container] = load.get(x.container, 0) + x.size
        else:
            assert x.container is None
    assert whole == {c.doc_id: c.tokens for c in counts.collect()} and max(load.values()) <= 100
    assert sum(load.values()) / (100 * len(load)) > 0.85
    assert packing.pack(packing.pieces(counts.limit(0), 100), 100).count() == 0


# ---------------------------------------------------------------- 8


def item(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(n)]


def test_leaks(spark):
    w = item(60, 1)
    items = [(1, "Read this now. " + " ".join(w) + ". And how many?"), (2, "Read this now. " + " ".join(item(40, 2)) + ". Why?"), (3, "Read this now. Short."), (4, None), (5, " ".join(w) + ". And then?")]
    noise = " ".join(item(50, 9))
    mark = [x.upper() if i % 3 else f"[[T|{x}]]" for i, x in enumerate(w[10:36])]
    docs = {
        1: noise + " " + " ".join(w[5:30]) + " " + noise,
        2: noise + " " + " ".join(w[5:29]) + " " + noise,
        3: " ''x'' ".join(["", "{{a|b}} ".join(mark), ""]),
        4: " ".join(x if i not in (7, 15) else "zzzzz" for i, x in enumerate(w[20:50])),
        5: " ".join(x if i % 8 else "zzzzz" for i, x in enumerate(w)),
        6: None,
        7: "",
        8: noise * 200,
    }
    df = frame(spark, [(i, t, 5) for i, t in docs.items()], "d bigint, text string, item_id int")
    got = {tuple(r) for r in leakage.leaks(df, "d", "text", items).collect()}
    assert got == {(d, i) for d in (1, 3, 4) for i in (1, 5)}
    assert leakage.leaks(df, "d", "text", []).count() == 0


def by_definition(p, d):
    """Whether 25 words or more of p stand somewhere in d with one edit in 12 at most, by trying all stretches."""
    for a in range(len(p) - 24):
        row = [0] * (len(d) + 1)
        for i in range(a, len(p)):
            new = [row[0] + 1]
            for j in range(1, len(d) + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i] != d[j - 1])))
            row = new
            if i - a >= 24 and min(row) * 12 <= i - a + 1:
                return True
    return False


@pytest.mark.parametrize("letters,least,most", [("abcdefghijklmnop", 1, 3), ("abcdefghijklmnop", 2, 9), ("abcdefghijklmnop", 50, 50), ("абвгдежзийклмн", 14, 14), ("абвгдежзийклмн", 26, 26)])
def test_leaks_lose_nothing(letters, least, most):
    true = found = 0
    for seed in range(30):
        r = random.Random(seed)
        word = lambda: "".join(r.choice(letters) for _ in range(r.randint(least, most)))
        p = [word() for _ in range(r.randint(25, 60))]
        size = r.randint(25, len(p))
        a = r.randint(0, len(p) - size)
        d = p[a : a + size]
        for _ in range(r.randint(0, size // 12 + 1)):
            k = r.randrange(1, len(d) - 1)
            d[k : k + r.randint(0, 1)] = [word() for _ in range(r.randint(0, 1))]
        # a stretch over the budget in the same region must not hide the one within it
        before = [x if i % 5 else word() for i, x in enumerate(p[:a])]
        doc = [word() for _ in range(10)] + before + d + [word() for _ in range(10)]
        hit = bool(leakage.Index([(1, p)]).leaked(" ".join(doc)))
        want = by_definition(p, doc)
        true, found = true + want, found + (want and hit)
        assert want or not hit
    assert true > 15 and found == true


def test_leaks_whatever_the_benchmark(spark, monkeypatch):
    w = item(60, 1)
    text = "Read the passage and answer the question. " + " ".join(w) + ". Why?"
    assert leakage.passage(text) == w and leakage.passage(None) == [] and leakage.passage("Beantworte die Frage. a b? c?") == ["a", "b"]
    df = frame(spark, [(1, " ".join(w[:20]) + "".join(w[20:31])), (2, "Read the passage and answer the question. " + " ".join(w[:20]))], "d bigint, text string")
    items = [(i, text) for i in range(5)]
    assert leakage.leaks(df, "d", "text", items).count() == 5
    monkeypatch.setattr(leakage, "MAX_INDEX_BYTES", 1)  # a slice an item
    assert leakage.leaks(df, "d", "text", items).count() == 5


def test_template_texts():
    long = " ".join(item(30, 3))
    assert wikitext.inline("{{q|a b|text=" + long + "|" + long + "}}").split() == (long + " " + long).split()


def test_wikitext():
    assert wikitext.inline("a{{b|{{c}}}} [[d|e]]<ref name=x>f</ref>''g''&amp;<!-- h -->{{open") == "a e" + "g&{{open"
    assert wikitext.inline("[[Category:X]][[y]]") == "y"


# ---------------------------------------------------------------- 9


def test_gradient():
    net = gru.ByteGRU(3, 4)
    x = np.random.default_rng(0).integers(1, 255, (6, 9)).astype(np.uint8)
    x[0, 5:] = gru.PAD
    y = np.array([0, 1, 2, 0, 1, 2])

    def loss():
        p = net.positions(x)
        mask = x.T != gru.PAD
        return -(np.log(p[np.arange(9)[:, None], y[None, :], np.arange(6)[None, :]]) * mask).sum() / mask.sum()

    before = {k: v.copy() for k, v in net.p.items()}
    assert abs(net.step(x, y, 0.0) - loss()) < 1e-4
    scale_free = {k: net.moments[k][0] / 0.1 for k in net.p}  # the clipped gradient
    for name, at in (("uf", (1, 2)), ("ub", (3, 11)), ("out", (5, 1)), ("cf", (6,)), ("xb", (int(x[1, 3]), 7))):
        net.p = {k: v.copy() for k, v in before.items()}
        net.p[name][at] += 1e-2
        up = loss()
        net.p[name][at] -= 2e-2
        numeric = (up - loss()) / 2e-2
        assert abs(numeric - scale_free[name][at]) < 2e-3 + 0.05 * abs(numeric), name


def test_languages(spark):
    de = "Der alte Kornmarkt wurde nach langem Streit über die Kosten neu errichtet und liegt an der Straße. "
    en = "The old grain market was rebuilt after a long dispute about its cost and lies on the road. "
    docs = [("de", de * 3)] * 40 + [("en", en * 3)] * 40 + [("en", de * 3)] * 3
    net = langid.train(docs)
    rows = [(1, en * 2, "en-GB"), (2, de * 2, "English"), (3, en + "\n\n" + de, "en"), (4, None, "en"), (5, "", None), (6, "#REDIRECT [[x]]", None), (7, de, None), (8, "* " + en, None), (9, "sdf;kjh;" * 50, None), (10, "== x ==\n\n" + en + "(''" + de + "'')", "und")]
    got = {(r.doc_id, r.seg): r.lang for r in langid.identify(frame(spark, rows, "doc_id bigint, text string, label string"), net).collect()}
    assert got == {(1, -1): "en", (2, -1): "de", (3, 0): "en", (3, 1): "de", (7, -1): "de", (10, -1): "en"}
    labels = ["EN", " en\t", "de-AT", "Español", "und", None, "xyz", "\u00a0fr", "unknown"]
    codes = [r.c for r in frame(spark, [(i, x) for i, x in enumerate(labels)], "i int, l string").orderBy("i").select(langid.label_codes(F.col("l")).alias("c")).collect()]
    assert codes == ["en", "en", "de", "es", None, None, None, "fr", None] == [c if (c := langid.label_code(x)) in langid.LANGS else None for x in labels]
    assert [langid.label_code(x) for x in ("EN", "de-AT", "Español", "und", None, "xyz")] == ["en", "de", "es", None, None, "xyz"]


def test_held_out_accuracy(spark, folder):
    docs = [(r.lang, r.text) for r in spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet").orderBy("doc_id").collect()]
    net = langid.train(docs[::2])
    good = n = 0
    for label, text in docs[1::2]:
        code = langid.label_code(label)
        parts = langid.segments(text)
        if code in langid.LANGS and parts:
            total = langid.score(net, [s for _, s in parts]).sum(axis=0)
            good, n = good + (langid.LANGS[int(total.argmax())] == code), n + 1
    assert good / n > 0.85  # about a tenth of the labels is wrong
