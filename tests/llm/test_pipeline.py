"""The pipeline's stages one by one against what they must leave, and its queries against their SQL."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages(spark, stages):
    from symgraph.llm import mixing, ngram_join, pieces, suffix_dedup

    names = spark.read.parquet(f"{DATA}/documents.parquet").columns
    (_, all_, clean), (_, _, single), (_, _, cut), (_, _, blocks), (_, _, ids) = stages
    assert all(x.columns == names for x in (clean, single, cut, blocks))
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    fine = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert len(kept & toxic) <= 0.5 * len(toxic) and len(fine - kept) <= 0.02 * len(fine)  # eleven toxic documents teach only the most frequent insults

    sets = {}
    for r in clean.where("text IS NOT NULL").collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r.doc_id for r in single.collect()} == {i for i in order if root(i) == i}
    assert ngram_join.similar_pairs(single).count() == 0
    assert suffix_dedup.repeated_spans(cut).where("copy").count() <= 2  # a cut may bring the words around it together
    tokens = sum(len(r.text.split()) for r in cut.collect())
    assert blocks.count() == sum(-(-n // mixing.LENGTH) for n in [r.n for r in cut.selectExpr("source", "size(filter(split(text, '[\\t\\n\\r ]+'), w -> w <> '')) AS k").groupBy("source").agg({"k": "sum"}).withColumnRenamed("sum(k)", "n").collect()]) and tokens
    assert ids.count() == blocks.count() and ids.where("NOT round_trip").count() == 0
    assert sorted(r.text for r in pieces.decode(ids).collect()) == sorted(r.text for r in blocks.collect())


def test_near_copies_stage_does_not_write_all_pairs(spark):
    """Groups are found from a few edges a document, however large a group of near copies is, and one document of each stays."""
    import random

    import corpus_pipeline
    from symgraph.llm import ngram_join

    r, rows, cuts = random.Random(8), [], []
    base = [word(r.randrange(4096)) for _ in range(60)]
    for i in range(300):
        w = list(base)
        w[r.randrange(60)] = w[r.randrange(60)] = f"other{i % 50}"
        rows.append((i + 5, " ".join(w)))
    rows += [(1000 + i, " ".join(word(r.randrange(4096)) for _ in range(60))) for i in range(5)]
    kept, ngram_join.cut = ngram_join.cut, lambda df: (cuts.append((made := kept(df)).count()), made)[1]
    try:
        got = corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), DATA)
        assert {x.doc_id for x in got.collect()} == {5, *range(1000, 1005)}
    finally:
        ngram_join.cut = kept
    assert max(cuts) < 305 * 40 < 300 * 299 // 2  # rows of any step's table


def word(i: int) -> str:
    return "w" + "".join("bcdfghjk"[(i >> 3 * k) & 7] + "aeiou"[(i >> 3 * k) % 5] for k in range(4))


def test_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ids with two texts and clashing columns through all stages; and no rows at all."""
    import collections

    import corpus_pipeline
    from symgraph.llm import pieces

    import random

    r = random.Random(4)
    text = lambda n: " ".join(word(r.randrange(4096)) for _ in range(n))
    passage, copied, long = text(60), text(90), text(30_000)
    rows = [(1, text(100)), (2, copied), (3, copied), (3, copied), (4, text(20) + " " + passage + " " + text(20)), (5, passage + " " + text(30)), (6, ""), (7, None), (None, text(70)), (None, None), (8, long), (9, " \n"), (10, text(80)), (10, text(80)), (11, "one")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, key string, h bigint, _gone string, _spans string, a bigint, part int"
    table = spark.createDataFrame([(i, t, None, ("src", None)[k % 2], None if t is None else len(t), "t", "k", 1, "g", "s", 2, 3) for k, (i, t) in enumerate(rows)], schema)
    for name, docs in (("awkward", table), ("nothing", table.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (10, 1, 0), (None, 1, 1), (2, None, None)] if name == "awkward" else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, folder)
            assert now.columns == docs.columns, stage
            now = spark.createDataFrame(now.collect(), docs.schema)
        got = corpus_pipeline.run(spark, folder)
        if name == "nothing":
            assert got.count() == 0 and now.count() == 0
            continue
        assert got.where("NOT round_trip").count() == 0
        # a copy goes, and of a passage the second place; rows without an id are in no block
        left = collections.Counter(w for i, t in {x for x in rows if x[0] is not None and x[0] != 3} if t for w in t.split())
        left.subtract(passage.split())
        mixed = collections.Counter(w for x in pieces.decode(got).collect() for w in x.text.split())
        assert set(mixed) <= set(+left) and sum(mixed.values()) > 0
        whole = collections.Counter(w for x in now.collect() for w in x.text.split())
        assert whole == mixed


def test_queries(spark):
    import duckdb

    from symgraph.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DATA, t)}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, DATA)
        rel = con.sql(sql)
        assert sorted(got.columns) == sorted(rel.columns)
        at = [rel.columns.index(c) for c in got.columns]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name
    assert len({n.split("_")[0] for n in queries.QUERIES}) == 10
