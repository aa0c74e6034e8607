"""Each operator against a brute-force version on a small table, and on awkward rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from symgraph.llm import fingerprints, knn, mixing, ngram_join, pieces, suffix_dedup, toxicity, urls, warc, wrappers

WORDS = [a + b + c for a in ("ba", "de", "ri", "so", "tu") for b in ("l", "m", "n", "r") for c in ("an", "et", "is", "o", "u")]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = DOCS + ", h string, token string, key string, part int, block int, _spans string, _gone string, _of string, shard int, pos int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    shared = prose(900, 70)
    out = [(i, prose(i, 120)) for i in range(12)]
    out += [(20, prose(1, 120)), (21, prose(1, 119) + " other"), (22, prose(50, 40) + " " + shared + " " + prose(51, 40)), (23, prose(52, 30) + "\n" + shared), (24, shared.upper())]
    out += [(30, ""), (31, "   \n\t"), (32, "a"), (33, "two words"), (34, "two words"), (35, None), (None, prose(60, 80)), (None, None), (36, "é ü 漢字 " * 30), (37, prose(70, 30_000)), (1, prose(1, 120)), (2, "the id again with another text")]
    return [(i, t, "en", None if i == 5 else f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, "a", "b", "c", 3, 4) for r in rows()], EXTRA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def grams(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(data: list[tuple]) -> dict:
    """Similarities of at least a half of all pairs of ids."""
    sets = collections.defaultdict(set)
    for i, t, *_ in data:
        if i is not None and t is not None and grams(t):
            sets[i].add(frozenset(grams(t)))
    out = {}
    for i in sets:
        for j in sets:
            s = max(len(a & b) / len(a | b) for a in sets[i] for b in sets[j])
            if i < j and s >= 0.5:
                out[i, j] = s
    return out


def grouped(ids: set, pairs: dict) -> dict:
    """The lowest id of each one's group."""
    of = {i: i for i in ids}
    while True:
        low = dict(of)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
        if low == of:
            return of
        of = low


CUT_UP = [{}, {"most": 3, "group": 2}, {"hot_share": 0.01, "hot_least": 2, "most": 4}]  # lists in cells, groups in parts, hot grams


@pytest.mark.parametrize("how", CUT_UP)
def test_similar_pairs(docs, awkward, nothing, how):
    want = brute(rows())
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(docs, **how).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {(r.doc_a, r.doc_b) for r in ngram_join.similar_pairs(awkward, **how).collect()} == set(want)
    assert ngram_join.similar_pairs(nothing, **how).count() == 0


def test_classes(docs, awkward, nothing):
    pairs = brute(rows())
    ids = {r[0] for r in rows()} - {None}
    first = grouped(ids, pairs)
    links = collections.Counter(x for p in pairs for x in p)
    for table in (docs, awkward):
        got = ngram_join.classes(table).collect()
        assert {(r.doc_id, r.class_id, r.links) for r in got if r.doc_id != 2} == {(i, first[i], links[i]) for i in ids - {2}}
        assert [(r.class_id, r.links) for r in got if r.doc_id == 2] == [(2, 0)] * 2  # two texts, two sets
    assert ngram_join.classes(nothing).count() == 0
    kept = ngram_join.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i in ids if first[i] == i}
    assert ngram_join.keep_first(nothing).count() == 0


@pytest.mark.parametrize("how", CUT_UP)
def test_no_planted_pair_is_lost(spark, how):
    r, data = random.Random(17), []
    base = [prose(8000 + k, 60).split() for k in range(8)]
    boiler = prose(7999, 40)
    for i in range(160):  # copies at all distances about the threshold, with a passage that all share, in groups of twenty
        w = list(base[i % 8])
        for _ in range(r.choice((0, 1, 3, 5, 6, 7, 8))):
            w[r.randrange(len(w))] = r.choice(WORDS) + "x"
        data.append((i, " ".join(w[: r.choice((60, 60, 40))]) + " " + boiler * (i % 3 > 0), "en", "s", 1))
    want = brute(data)
    assert len(want) > 500 and sum(s < 0.55 for s in want.values()) > 20
    got = {(x.doc_a, x.doc_b): x.jaccard for x in ngram_join.similar_pairs(spark.createDataFrame(data, DOCS), **how).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def near_copies(texts: int, copies: int, length: int, changes: int, seed: int = 5) -> list[tuple]:
    """Near, never equal, copies of a few texts, some of them long, and texts that are like no other."""
    r, out = random.Random(seed), []
    for k in range(texts):
        base = prose(7000 + k, length).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(1, changes)):
                w[r.randrange(length)] = r.choice(WORDS) + r.choice(("x", "y", "z"))
            out.append(" ".join(w))
    out += [prose(6000 + k, length) for k in range(copies // 4)] + out[:9]  # equal ones too
    return [(i, t, "en", "s", 1) for i, t in enumerate(out)]


@pytest.mark.parametrize("how", [{}, {"few": 4, "cell": 7}, {"few": 2, "cell": 30, "most": 16}])
def test_groups_of_near_copies_are_blocks(spark, how):
    """What travels follows the documents, not the square of a group's size; links, classes and pairs are those of all pairs."""
    data = near_copies(2, 110, 90, 18)
    want, docs = brute(data), spark.createDataFrame(data, DOCS)
    links = collections.Counter(x for p in want for x in p)
    first = grouped({d[0] for d in data}, want)
    assert len(want) > 1_500 and len(want) < 2 * 110 * 109 // 2
    assert {(r.doc_id, r.class_id, r.links) for r in ngram_join.classes(docs, **how).collect()} == {(i, first[i], links[i]) for i in first}
    assert {r.doc_id for r in ngram_join.keep_first(docs, **how).collect()} == {i for i in first if first[i] == i}
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(docs, **how).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_rows_of_a_group_grow_with_its_size(spark):
    written = []
    for copies in (150, 600):
        docs = spark.createDataFrame(near_copies(1, copies, 60, 6), DOCS)
        kept, ngram_join.shared_table = ngram_join.shared_table, lambda df, name: written.append((name, made := kept(df, name), made.count())) or made
        try:
            ngram_join.classes(docs).count()
        finally:
            ngram_join.shared_table = kept
    small, large = (n for name, _, n in written if name == "pairs")
    assert large <= 8 * small and large < 600 * 20


def test_product():
    r = np.random.default_rng(3)
    for left, right, width in ((40, 0, 30), (30, 50, 4000), (90, 60, 300)):
        x = r.random((left + right, width)) < r.random(width) ** 4
        owner, gram = np.nonzero(x)
        y = x.astype(int)
        want = y[:left] @ (y[left:] if right else y).T
        got = ngram_join.product(gram.astype(np.uint64), owner, left, right)
        assert (got == want)[~np.eye(*want.shape, dtype=bool) if not right else slice(None)].all()


def test_overlaps():
    r = random.Random(3)
    sets = [np.array(sorted(r.sample(range(300), r.randrange(5, 90))), np.uint64) for _ in range(40)] + [np.arange(10, 60, dtype=np.uint64)] * 2
    wanted = np.array([(i, j) for i in range(42) for j in range(i)])
    assert ngram_join.overlaps(sets, wanted).tolist() == [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in wanted]


def spans(texts: list[tuple[int, str]], least: int) -> set:
    seen, out = {}, collections.defaultdict(set)
    words = {(i, n): t.split() for n, (i, t) in enumerate(sorted(set(texts)))}
    windows = sorted((i, s, tuple(w[s : s + least])) for (i, _), w in words.items() for s in range(len(w) - least + 1))
    places = collections.defaultdict(set)
    for i, s, w in windows:
        places[w].add((i, s))
    for w, at in places.items():
        if len(at) > 1:
            first = min(at)
            for i, s in at:
                out[i, (i, s) != first].update(range(s, s + least))
    del seen
    found = set()
    for (i, copy), at in out.items():
        run = sorted(at)
        start = last = run[0]
        for x in run[1:] + [None]:
            if x is None or x > last + 1:
                found.add((i, start, last + 1, copy))
                start = x
            last = x
    return found


def test_repeated_spans(spark, docs, awkward, nothing):
    plain = [(i, t) for i, t, *_ in rows() if i is not None and t is not None]
    some = spark.createDataFrame([(i, t, None, None, None) for i, t in plain], DOCS)
    for hot in (suffix_dedup.HOT, 2, 0):  # anchors with more places than these go another way
        assert {tuple(r) for r in suffix_dedup.repeated_spans(some, hot=hot).collect()} == spans(plain, 50)
    loop = [(1, " ".join(["one", "two", "three"] * 60)), (2, prose(3, 90)), (3, prose(3, 90))]
    for hot in (suffix_dedup.HOT, 0):
        assert {tuple(r) for r in suffix_dedup.repeated_spans(spark.createDataFrame([(*x, None, None, None) for x in loop], DOCS), hot=hot).collect()} == spans(loop, 50)
    assert suffix_dedup.repeated_spans(nothing, hot=0).count() == 0
    assert suffix_dedup.repeated_spans(nothing).count() == 0
    out = suffix_dedup.without_copies(awkward)
    assert out.columns == awkward.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert 20 not in texts and texts[23].text.split() == prose(52, 30).split() and texts[23].n_chars == len(texts[23].text)
    assert [x.text for x in out.collect() if x.doc_id == 2] == [t for i, t, *_ in rows() if i == 2]
    apart = [(1, prose(1, 100)), (2, prose(1, 100)), (2, prose(9, 100)), (3, prose(1, 100)), (3, prose(1, 100))]  # an id with two texts
    left = suffix_dedup.without_copies(spark.createDataFrame([(*x, None, None, None) for x in apart], DOCS)).collect()
    assert sorted((x.doc_id, x.text) for x in left) == sorted([apart[0], apart[2]])
    assert suffix_dedup.without_copies(nothing).count() == 0
    assert texts[35].text is None and texts[30].text == "" and texts[24].text == prose(900, 70).upper()


def test_fingerprints(docs, awkward, nothing):
    got = fingerprints.fingerprints(docs).collect()
    want = [(i, t) for i, t, *_ in rows() if i is not None and t is not None]
    assert len(got) == len(want)

    def hash_of(t):
        out = []
        for p, b in zip(fingerprints.PRIMES, fingerprints.BASES, strict=True):
            h = 0
            for c in reversed(t):
                h = (h * b + ord(c)) % p
            out.append(h)
        return out[0] << 31 | out[1]

    leaders = {}
    for i, t in sorted(want):
        leaders.setdefault(t[:64], (i, t))

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert sorted(map(tuple, got)) == sorted((i, len(t), hash_of(t), leaders[t[:64]][0], common(t, leaders[t[:64]][1])) for i, t in want)
    assert sorted(map(tuple, fingerprints.fingerprints(awkward).collect())) == sorted(map(tuple, got))
    assert fingerprints.fingerprints(nothing).count() == 0


def test_span_equality():
    codes = np.array([ord(c) for c in "abcabcabxabcabc"])
    p = fingerprints.Prefixes(codes)
    assert p.extension(np.array([0, 0, 3]), np.array([3, 9, 0]), np.array([12, 6, 12])).tolist() == [5, 6, 5]
    assert p.equal(np.array([0, 0]), np.array([3, 9]), np.array([6, 6])).tolist() == [False, True]


def test_span_fingerprints(spark, docs, nothing):
    texts = {i: t for i, t, *_ in rows() if i is not None and t is not None and i not in (1, 2)}
    r = random.Random(12)
    asked = [(i, s := r.randrange(len(t)), r.randrange(len(t) - s + 1)) for i, t in texts.items() if t for _ in range(8)]
    asked += [(22, texts[22].index(prose(900, 70)), 200), (23, texts[23].index(prose(900, 70)), 200), (36, 1, 3), (36, 9, 3), (36, 8, 0)]  # the same passage in two documents, and in one
    more = [(30, 0, 1), (0, -1, 2), (0, 0, 10**9), (None, 0, 1), (0, None, 1), (35, 0, 0), (777, 0, 1)]
    got = {tuple(x)[:3]: x.fingerprint for x in fingerprints.span_fingerprints(docs, spark.createDataFrame(asked + more, "doc_id bigint, start int, length int")).collect()}
    assert got.keys() == set(asked)
    by = collections.defaultdict(set)
    for (i, s, n), f in got.items():
        by[texts[i][s : s + n]].add(f)
    assert all(len(f) == 1 for f in by.values()) and len({f for fs in by.values() for f in fs}) == len(by) and by[""] <= {0}
    assert fingerprints.span_fingerprints(nothing, spark.createDataFrame(asked, "doc_id bigint, start int, length int")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 6)), 1).astype(np.float32)
    x[50:60] = x[0]
    data = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[0].tolist()), (900, None), (901, []), (902, [float("nan")] * 6), (903, [1.0, 2.0])]
    table = spark.createDataFrame([(*d, "s", 1) for d in data], "vec_id bigint, embedding array<float>, shard string, rank int")
    got = collections.defaultdict(list)
    for r in sorted(knn.nearest(table, k=4, leaf=16, shard_rows=70).collect(), key=lambda r: (r.vec_id, r.rank)):
        got[r.vec_id].append((r.neighbour, round(r.distance, 9)))
    y = x.astype(float)

    def want(i: int) -> list:
        d = ((y - y[i]) ** 2).sum(1)
        return [(int(j), round(float(np.sqrt(d[j])), 9)) for j in np.lexsort((np.arange(300), d)) if j != i][:4]

    assert all(got[i] == want(i) for i in range(300)) and set(got) == set(range(300))
    some = collections.defaultdict(list)
    for r in sorted(knn.nearest(table, table.where("vec_id % 50 = 0 OR vec_id IS NULL"), k=4, leaf=16, shard_rows=20, sample=64).collect(), key=lambda r: (r.vec_id, r.rank)):
        some[r.vec_id].append((r.neighbour, round(r.distance, 9)))
    assert some == {i: want(i) for i in range(0, 300, 50)}
    assert knn.nearest(table.limit(0)).count() == 0 and knn.nearest(table, table.limit(0)).count() == 0
    assert knn.nearest(table.where("vec_id = 3")).count() == 0  # one row has no neighbour
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)], "vec_id bigint, embedding array<float>")  # one point, several shards
    near = knn.nearest(same, k=3, leaf=8, shard_rows=20).collect()
    assert len(near) == 270 and {(r.neighbour, r.rank) for r in near if r.vec_id == 50} == {(0, 1), (1, 2), (2, 3)} and {r.neighbour for r in near if r.vec_id == 1} == {0, 2, 3}


def test_toxicity(spark, nothing):
    r = random.Random(4)
    insults = ["zorgface", "blathead", "wumpkin"]
    data, labels = [], []
    for i in range(600):
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(60)]
        if i % 6 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(insults))
        data.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    docs = spark.createDataFrame(data, DOCS)
    known = spark.createDataFrame(labels[:400] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, known)
    got = {x.doc_id: x.toxic for x in toxicity.toxic_scores(docs, model).collect()}
    assert sum(got[i] == (i % 6 == 0) for i in range(400, 600)) >= 196
    odd = spark.createDataFrame([(1, "you zorg-face", "x"), (2, prose(8, 30), "x"), (3, "z o r g f a c e", "x"), (4, None, "x"), (None, "zorgface", "x"), (5, "", "x"), (6, "zorgxface", "x")], "doc_id bigint, text string, score string")
    flags = {x.doc_id: x.toxic for x in toxicity.toxic_scores(odd, model).collect()}
    assert flags[1] and flags[3] and flags[6] and not flags[2] and not flags[5] and 4 not in flags
    left = toxicity.without_toxic(odd, model)
    assert left.columns == odd.columns and {x.doc_id for x in left.collect()} == {2, 4, 5}
    assert toxicity.without_toxic(nothing, toxicity.train(nothing, known)).count() == 0


def naive_kernel(a: str, b: str) -> float:
    """Common subsequences of three letters, each gap less than REACH letters, weighed by DECAY to the power of both spans, over the norms."""

    def weights(w: str) -> dict:
        w, out = "`" + w + "`", collections.defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, min(i + toxicity.REACH, len(w) - 1) + 1):
                for k in range(j + 1, min(j + toxicity.REACH, len(w) - 1) + 1):
                    if k < len(w):
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y[u] for u, v in x.items() if u in y) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_string_kernel():
    words = ["idiot", "idxiot", "abcab", "aaaa", "idiots", "zzz"]
    rows = {}
    for w in words:
        matrix = np.array([[0, *(ord(c) - 96 for c in w), 0]], np.int32)
        _, u, v = toxicity.features(matrix)
        rows[w] = dict(zip(u.tolist(), v.tolist(), strict=True))
    for a in words:
        for b in words:
            got = sum(v * rows[b].get(u, 0) for u, v in rows[a].items())
            assert abs(got - naive_kernel(a, b)) < 1e-9
    assert naive_kernel("idiot", "idxiot") > 0.6 > naive_kernel("idiot", "abcab")


def test_letters_by_their_code_points():
    def classes(text: str) -> list:
        raw = np.frombuffer(text.encode(), np.uint8)
        return toxicity.fold(raw, np.array([0, len(raw)]))[0].tolist()

    other = toxicity._OTHER
    assert classes("рыба") == [other] * 4 and classes("©©©") == [] and classes("漢字") == [other] * 2
    assert classes("Ïdíøt") == classes("idiot") and classes("i\u2019d\u200bi\u2014ot") == classes("idiot") and classes("i😀diot") == classes("idiot") and classes("3×4÷5") == classes("345")


def test_toxicity_of_awkward_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "word " * 40_000 + "more"), (3, "word"), (3, "word")], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, None), (None, 1)], "doc_id bigint, toxic int"))
    assert sorted((r.doc_id, r.toxic) for r in toxicity.toxic_scores(docs, model).collect()) == [(2, False), (3, False), (3, False), (3, False)]
    assert toxicity.without_toxic(docs, model).count() == 6


def test_urls(spark):
    held = [("http://mega-casino-slots.example/bonus", 1), ("http://m.cheap-pills-now.example/en/12", 1), ("http://free-porn-xxx.example/watch", 1), ("http://poker-bonus.example/play", 1), ("http://adserver2.example/click?aff=3&cid=9", 1), ("http://science-weekly.example/articles/black-holes", 0), ("http://docs.history.example/guide/rome", 0), ("http://daily.example/2019/06/storm-season", 0), ("http://blog.gardening.example/posts/soil", 0), ("http://library.example/books/kant", 0)]
    pages = spark.createDataFrame([(i, u, "<p>", 1.0) for i, (u, _) in enumerate(held)] + [(90, None, "", 1.0), (None, "", None, 1.0), (0, held[0][0], "", 1.0), (91, "x" * 50_000, "", 1.0)], "page_id bigint, url string, html string, keep double")
    got = urls.url_scores(pages, urls.seed_model()).collect()
    assert len(got) == 14
    by = {r.page_id: r for r in got}
    assert sum(by[i].keep == (y == 0) for i, (_, y) in enumerate(held)) >= 9
    assert by[90].keep and by[90].unwanted is None
    model = urls.train(spark.createDataFrame([*held, (None, 1), ("u", None)], "url string, unwanted int"))
    assert sum(r.keep == (held[r.page_id][1] == 0) for r in urls.url_scores(pages.where("page_id < 10"), model).collect()) == 11
    assert urls.url_scores(pages.limit(0), urls.train(spark.createDataFrame([], "url string, unwanted int"))).count() == 0


def page(title: str, items: list[str], paras: list[str], extra: str = "") -> str:
    links = "".join(f"<li><a href='/'>{x}</a></li>" for x in items)
    return f"<html><head><title>{title}</title><script>x='<p>no</p>'</script></head><body><nav><ul>{links}</ul></nav><!-- no -->{extra}<article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paras)}</article><footer>All rights</footer></body></html>"


def test_wrappers(spark):
    data, want = [], {}
    for i in range(30):
        paras = [prose(i * 10 + k, 40) for k in range(1 + i % 4)]
        data.append((i, "https://a.example/x/" + str(i), page(f"Title {i}", [f"l{i}{k}" for k in range(1 + i % 3)], paras, f"<div>ad {i}</div>" if i % 5 == 0 else "")))
        want[i] = paras
    data += [(100, None, "<p>alone</p>"), (101, "https://b.example/", None), (102, "https://b.example/", ""), (103, "https://b.example/2", "no tags < at all"), (0, *data[0][1:]), (104, "https://c.example/", "<p>" * 3000 + "deep")]
    got = {r.page_id: r for r in wrappers.extracted(spark.createDataFrame([(*d, "h") for d in data], "page_id bigint, url string, html string, host string")).collect()}
    for i in range(30):
        assert got[i].matched and got[i].text.split("\n") == want[i]
        assert "All rights" not in got[i].fields and f"Title {i}" in got[i].fields and not any("no" == f for f in got[i].fields)
    assert got[101].fields is None and got[102].fields == [] and got[100].fields == ["alone"]
    assert wrappers.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_wrappers_lose_no_text(spark):
    long = [prose(2000 + i, 30) for i in range(30)]
    many = lambda k: "".join(f"<h{1 + i % 6}>{long[(i + k) % 30]}</h{1 + i % 6}><hr>" + f"<x{i}>" for i in range(30))
    data = [(1, "https://one.example/", f"<p>{long[0]}</p><p>All rights</p>"), (2, "https://one.example/2", f"<p>{long[1]}</p><ul><li>{long[2]}</li></ul><p>All rights</p>")]
    data += [(k, "https://copies.example/", f"<p>{long[3]}</p>") for k in (3, 4, 5)]
    data += [(6, "https://empty.example/", ""), (7, "https://empty.example/2", "no tags < at all"), (8, "https://many.example/", many(0)), (9, "https://many.example/2", many(1))]
    data += [(k, "https://template.example/", f"<div>All rights</div><p>{long[k]}</p>") for k in (10, 11, 11)]
    got = collections.defaultdict(list)
    for r in wrappers.extracted(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect():
        got[r.page_id].append(r)
    assert long[2] in got[2][0].fields and long[2] in got[2][0].text.split("\n")  # an optional group that one page fills
    assert all(got[k][0].text == long[3] for k in (3, 4, 5))  # copies alone make no template
    assert got[6][0].fields == [] and got[7][0].fields == ["no tags < at all"] and got[7][0].text == "no tags < at all"
    assert sorted(got[8][0].text.split("\n")) == sorted(got[9][0].text.split("\n")) == sorted(long)  # thirty slots of a thirtieth each
    assert all(r.fields == [long[k]] and r.text == long[k] for k in (10, 11) for r in got[k])


def test_folding_and_alignment():
    unit = [f"t{i}" for i in range(12)]
    assert wrappers.fold(["a", *unit * 5, "b"], [[] for _ in range(62)])[0] == ["a", ["+", unit], "b"]
    r = random.Random(6)
    for n in (0, 1, 7, 40):
        for cells in (1, 50, 1 << 20):
            wrappers.CELLS = cells
            a, b = ([r.randrange(4) for _ in range(k)] for k in (n, 30))
            ways = wrappers.common(np.array(a, np.int64), np.array(b, np.int64))
            assert ways.count("=") + ways.count("-") == len(a) and ways.count("=") + ways.count("+") == len(b)
            i, j, best = 0, 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for w in ways:
                assert w != "=" or a[i] == b[j]
                i, j = i + (w != "+"), j + (w != "-")
            for x in range(len(a)):
                for y in range(len(b)):
                    best[x + 1][y + 1] = best[x][y] + 1 if a[x] == b[y] else max(best[x][y + 1], best[x + 1][y])
            assert ways.count("=") == best[-1][-1]
    wrappers.CELLS = 1 << 20
    long = [np.array([r.randrange(3000) for _ in range(6000)]) for _ in range(2)]
    assert wrappers.common(*long).count("-") < 6000  # 36 million cells


def test_wrappers_of_many_layouts(spark):
    r = random.Random(8)
    data = []
    for i in range(150):  # each page of the host has its own order of parts
        parts = [f"<h{k}>{prose(7000 + 10 * i + k, 20)}</h{k}>" for k in range(1, 7)]
        r.shuffle(parts)
        data.append((i, "https://many.example/", "<div>All rights</div>" + "<hr>".join(parts[: 2 + i % 5])))
    data.append((999, "https://many.example/", "<ul>" + "".join(f"<li><x{k % 50}>{prose(k, 4)}</x{k % 50}></li>" for k in range(1500)) + "</ul>"))
    for how in ({}, {"layouts": 4}):
        got = {x.page_id: x for x in wrappers.extracted(spark.createDataFrame(data, "page_id bigint, url string, html string"), **how).collect()}
        for i, _, html in data:
            texts = wrappers.tokens(html)[1]
            assert got[i].matched and [t for t in texts if t != "All rights"] == [t for t in got[i].fields if t != "All rights"]


def test_toxicity_trains_on_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_fit", lambda labelled, landmarks=0: seen.extend(labelled))
    text = prose(5000, 30_000) + " zzyzxword"
    toxicity.train(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int"))
    assert seen == [(toxicity._fold_text(text), 1)] and any("zzyzx" in u for u in seen[0][0])


def test_warc(spark):
    data = [(1, "http://a/", "x" * 100), (2, "http://b/\r\n", "é" * 40), (3, None, ""), (4, "u", None), (None, "n", "WARC/1.0\r\n\r\n"), (1, "http://a/", "x" * 100), (5, "big", prose(1, 60_000))]
    table = warc.chunk_table(spark.createDataFrame([(*d, 1) for d in data], "page_id bigint, url string, html string, chunk_no int"), chunk=64)
    assert table.where("error IS NOT NULL").count() == 0
    got = collections.defaultdict(list)
    for r in table.collect():
        got[r.page_id, r.url].append(r)
    for page_id, url, html in data:
        raw = (html or "").encode()
        mine = sorted(got[page_id, url.replace("\r", "%0D").replace("\n", "%0A") if url else url], key=lambda r: r.chunk_no)
        if page_id == 1:
            mine = mine[::2]
        assert b"".join(bytes(r.payload) for r in mine) == raw
        assert [r.start for r in mine] == list(range(0, max(1, len(raw)), 64)) and [r.last for r in mine] == [False] * (len(mine) - 1) + [True]
        assert all(r.digest == hashlib.sha256(raw[: r.start + r.n_bytes]).hexdigest() for r in mine)
    assert {(r.page_id, r.record_id) for rs in got.values() for r in rs} == {(i, f"urn:page:{'' if i is None else i}:{hashlib.sha256((h or '').encode()).hexdigest()[:16]}") for i, _, h in data}
    assert warc.chunk_table(table.selectExpr("page_id", "url", "'' AS html").limit(0)).count() == 0


def test_warc_query_returns_payload(spark):
    import duckdb
    from symgraph.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    rel, got = con.sql(queries.ORACLE_SQL["op8_warc"]), queries.QUERIES["op8_warc"](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(rel.columns) and "payload" in got.columns
    plain = lambda rs: sorted(repr(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in rs)
    assert plain(got.select(*rel.columns).collect()) == plain(rel.fetchall())


def test_warc_plain_and_foreign():
    import io

    body = b"WARC/1.0\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for raw in (body, zlib.compress(body, 1, 31)):
        assert [(r[0], r[3], r[8], r[7], r[9]) for r in warc.records(warc.Stream(io.BytesIO(raw)), 3, "f")] == [("urn:uuid:1", 0, b"hel", False, None), ("urn:uuid:1", 1, b"lo", True, None), ("f#1", 0, b"", True, None)]


def test_broken_warc():
    import io

    good = b"WARC/1.0\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    cases = [(b"WARC/1.0\r\nWARC-Record-ID: <b>\r\n\r\nx", "b", "no content length"), (b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort", "f#1", "cut short"), (b"what\r\n", "f#1", "not a WARC record"), (b"WARC/1.0\r\nContent-Length: -1\r\n\r\n", "f#1", "no content length")]
    for bad, record, error in cases:
        rows = list(warc.records(warc.Stream(io.BytesIO(good + bad)), 4, "f"))
        assert (rows[0][8], rows[0][7], rows[0][9]) == (b"abc", True, None) and (rows[-1][0], rows[-1][9], rows[-1][7]) == (record, error, False)
    assert [r[8] for r in warc.records(warc.Stream(io.BytesIO(good + cases[1][0])), 4, "f")] == [b"abc", b"shor", b"t"]
    packed = bytearray(zlib.compress(good, 1, 31) + zlib.compress(good, 1, 31))
    at = len(packed) // 2 + 10
    packed[at : at + 6] = b"\xff" * 6
    rows = list(warc.records(warc.Stream(io.BytesIO(bytes(packed))), 4, "f"))
    assert rows[0][8] == b"abc" and rows[-1][9].startswith("damaged") and list(warc.records(warc.Stream(io.BytesIO(b"")), 4)) == []


def test_mixing(spark, docs, awkward, nothing):
    blocks = mixing.mixed_blocks(docs, length=50, shard_slots=8).collect()
    words = collections.Counter()
    per = collections.defaultdict(int)
    for i, t, _, s, _ in rows():
        if i is not None and t is not None:
            per[s or ""] += len(t.split())
            words.update(t.split())
    sizes = {s: -(-n // 50) for s, n in per.items() if n}
    assert len(blocks) == sum(sizes.values())
    assert sorted((b.shard, b.slot) for b in blocks) == [(k // 8, k % 8) for k in range(len(blocks))]
    assert all(len(b.text.split()) == b.n_tokens == (50 if b.block < sizes[b.source] - 1 else per[b.source] - 50 * (sizes[b.source] - 1)) for b in blocks)
    share = np.array([sizes[s] ** mixing.TEMPER for s in sorted(sizes)])
    share /= share.sum()
    for shard in {b.shard for b in blocks}:
        drawn = mixing.draw(shard, min(8, len(blocks) - 8 * shard), share, mixing.SEED)
        assert collections.Counter(b.source for b in blocks if b.shard == shard) == {s: n for s, n in zip(sorted(sizes), drawn.tolist(), strict=True) if n}
    for s, n in sizes.items():  # no block again before all have come
        order = [b.block for b in sorted(blocks, key=lambda b: (b.shard, b.slot)) if b.source == s]
        assert all(len(set(order[k : k + n])) == len(order[k : k + n]) for k in range(0, len(order), n))
    again = mixing.mixed_blocks(awkward.repartition(7), length=50, shard_slots=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, blocks))
    whole = mixing.mixed_blocks(docs, weights={"src1": 1.0}, length=50, slots=sizes["src1"]).collect()
    assert collections.Counter(w for b in whole for w in b.text.split()) == collections.Counter(w for i, t, _, s, _ in rows() if i is not None and t is not None and s == "src1" for w in t.split())
    assert mixing.mixed_blocks(nothing).count() == 0 and mixing.as_documents(mixing.mixed_blocks(docs), awkward).columns == awkward.columns


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64)).tolist()) == list(range(n))


def test_pieces(docs, awkward, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = sorted((r.doc_id, list(r.ids), r.round_trip) for r in pieces.encode(awkward).collect())
    want = sorted((i, sp.encode(t), True) for i, t, *_ in rows() if i is not None and t is not None)
    assert got == want
    back = pieces.decode(pieces.encode(docs))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t) for i, t, *_ in rows() if i is not None and t is not None)
    assert pieces.encode(nothing).count() == 0 and pieces.decode(pieces.encode(nothing)).count() == 0
