"""Symbol and text search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.names import LANGUAGES, basename, dirname, is_test_file, kind_bonus, name_bonus
from symgraph.functions.stemming import porter, stem_counts
from symgraph.functions.terms import is_test_query, plain_name, search_terms
from symgraph.operators import lookup

K1, B = 1.2, 0.75
NOT_WORD = r"[^\p{L}\p{N}]+"


@dataclass
class ParsedQuery:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


KINDS = {"file", "module", "class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field", "variable", "constant", "enum", "enum_member", "type_alias", "namespace", "parameter", "import", "export", "route", "component"}


LANGUAGE_NAMES = {*LANGUAGES.values(), "unknown"}


def parse_query(raw: str) -> ParsedQuery:
    """Free words and the filters kind:, lang: (language:), path: and name:, whose values may be quoted; an unknown kind or language stays text."""
    out, words = ParsedQuery(), []
    for token in re.findall(r'(?:[^\s"]|"[^"]*"|"[\s\S]*$)+', raw):
        key, _, value = token.partition(":")
        value = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
        where = {"kind": out.kinds, "lang": out.languages, "language": out.languages, "path": out.paths, "name": out.names}.get(key.lower())
        if where is out.languages:
            value = value.lower()
        if where is None or not value or where is out.kinds and value not in KINDS or where is out.languages and value not in LANGUAGE_NAMES:
            words.append(token)
        else:
            where.append(value)
    out.text = " ".join(words).strip()
    return out


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): counts of each text's lower-cased words, and how many it has."""
    terms = docs.select(F.col(key).alias("key"), F.filter(F.split(F.lower(F.col(text)), NOT_WORD), lambda t: t != "").alias("terms"))
    return terms.select("key", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("key", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], limit: int | None = None) -> DataFrame:
    """(key, score): Okapi BM25 of documents that have any of the words of query. Only their counts of these words are shuffled."""
    terms = F.filter(F.split(F.lower(F.col(text)), NOT_WORD), lambda t: t != "")
    counts = [(F.size("terms") - F.size(F.array_remove("terms", w))).alias(f"tf{i}") for i, w in enumerate(query)]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), terms.alias("terms")).select("key", F.size("terms").alias("length"), *counts)
    total = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    score: Column = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hit = rows.where(" OR ".join(f"tf{i} > 0" for i in range(len(query))))
    out = hit.crossJoin(F.broadcast(total)).select("key", F.round(score, 6).alias("score"))  # total is one row
    return out.orderBy(F.desc("score"), "key").limit(limit) if limit else out


#: Weights of a symbol's columns in ranked search.
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}


def match_terms(text: str) -> list[list[str]]:
    """The phrases that a text asks for, of each the words; the last word of a phrase may go on. Operators of query languages are no terms."""
    phrases = [[w for w in re.split(r"[\W_]+", t.lower()) if w] for t in text.split() if t.upper() not in ("AND", "OR", "NOT", "NEAR")]
    return [p for p in phrases if p]


def _hits(words: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w.startswith(phrase[0])))

    def at(i: Column) -> Column:
        same = [F.get(words, i + k) == w for k, w in enumerate(phrase[:-1])] + [F.get(words, i + len(phrase) - 1).startswith(phrase[-1])]
        out = F.coalesce(same[0], F.lit(False))
        for x in same[1:]:
            out = out & F.coalesce(x, F.lit(False))
        return out

    return F.when(F.size(words) >= len(phrase), F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at))).otherwise(0)


def fts(rows: DataFrame, text: str, weights: dict[str, float], where: Column | None = None) -> DataFrame:
    """rows that have any phrase of text in the columns of weights, with a BM25 ``score`` to which hits in a column count by its weight.

    One pass finds how many rows have each phrase, one row that is broadcast, and another scores; no index is kept. where: rows that count in
    the statistics but aren't wanted are left out after scoring.
    """
    phrases = match_terms(text)
    if not phrases:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    columns = [c for c in weights if c in rows.columns]
    words = {c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), NOT_WORD), lambda t: t != "") for c in columns}
    counted = rows.withColumns({f"_w{i}": words[c] for i, c in enumerate(columns)})
    size, zero = F.lit(0), F.lit(0)
    for i in range(len(columns)):
        size = size + F.size(f"_w{i}")
    counted = counted.withColumn("_size", size)
    for k, p in enumerate(phrases):
        hits = [_hits(F.col(f"_w{i}"), p) for i in range(len(columns))]
        any_, much = zero, F.lit(0.0)
        for c, h in zip(columns, hits, strict=True):
            any_, much = any_ + h, much + weights[c] * h
        counted = counted.withColumns({f"_n{k}": any_, f"_f{k}": much})
    return _scored(counted.drop(*[f"_w{i}" for i in range(len(columns))]), len(phrases), where).select(*rows.columns, "score")


def _scored(counted: DataFrame, phrases: int, where: Column | None) -> DataFrame:
    """Rows that have any phrase, with their score: of each row its words (_size), and of each phrase k how often it stands there (_n<k>), and by weight (_f<k>)."""
    total = counted.agg(F.count("*").alias("_rows"), F.avg("_size").alias("_mean"), *[F.count_if(F.col(f"_n{k}") > 0).alias(f"_d{k}") for k in range(phrases)])
    score: Column = F.lit(0.0)
    for k in range(phrases):
        f, d = F.col(f"_f{k}"), F.col(f"_d{k}")
        idf = F.log((F.col("_rows") - d + 0.5) / (d + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_size") / F.col("_mean")))).otherwise(0.0)
    hit = counted.where(" OR ".join(f"_n{k} > 0" for k in range(phrases)))
    hit = hit.where(where) if where is not None else hit
    return hit.crossJoin(F.broadcast(total)).withColumn("score", score)  # total is one row


def search_fts(nodes: DataFrame, text: str, kinds: list[str] | None = None, languages: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """nodes with a ``score``: ranked search over ids, names, docstrings and signatures, five times limit or 100 rows."""
    where = F.lit(True)
    where = where & F.col("kind").isin(kinds) if kinds else where
    where = where & F.col("language").isin(languages) if languages else where
    return fts(nodes, text, WEIGHTS, where).orderBy(F.desc("score"), "id").offset(offset).limit(max(5 * limit, 100))


def search_like(nodes: DataFrame, query: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """(id, name, score): 1.0 for the name, 0.9 for its beginning, 0.8 within it, 0.7 within the qualified name."""
    return like(nodes, query).orderBy(F.desc("score"), F.length("name"), "name", "id").offset(offset).limit(limit).select("id", "name", "score")


def like(nodes: DataFrame, query: str) -> DataFrame:
    q, low = query.lower(), F.lower("name")
    score = F.when(F.col("name") == query, 1.0).when(low.startswith(q), 0.9).when(low.contains(q), 0.8).when(F.lower("qualified_name").contains(q), 0.7)
    return nodes.withColumn("score", score).where("score IS NOT NULL")


def fuzzy(nodes: DataFrame, query: str, limit: int = 10, each: int = 5) -> DataFrame:
    """(id, name, distance, score): names within an edit distance of 1 (up to four letters) or 2; at most ``each`` symbols of a name."""
    return fuzzy_nodes(nodes, nodes, query, limit, each).select("id", "name", "distance", "score")


def fuzzy_nodes(nodes: DataFrame, wanted: DataFrame, query: str, limit: int, each: int = 5) -> DataFrame:
    """Rows of wanted whose names are near; the names are those of all nodes. Only names, each once, are compared."""
    q, most = query.lower(), 1 if len(query) <= 4 else 2
    names = nodes.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(q), most)).where("distance >= 0")
    names = names.orderBy("distance", "name").limit(max(2 * limit, 50))
    w = Window.partitionBy("name").orderBy("id")
    found = wanted.join(F.broadcast(names), "name").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")  # at most max(2 * limit, 50) names
    return found.withColumn("score", F.round(1 / (1 + F.col("distance")), 6))


def path_relevance(path: Column, query: str, project: frozenset[str] | set[str] = frozenset()) -> Column:
    """For each word of the query 10 if a term of it is in the file's name, else 5 in the folders', else 3 in the path; 15 less for tests, unless it asks for them.

    Words that are the project's own name (``project``: such names in plain letters) don't count, unless all are.
    """
    if not query.split():
        return F.lit(0)
    words = [w for w in query.split() if plain_name(w) not in project] or query.split()
    name, folder, low = F.lower(basename(path)), F.lower(dirname(path)), F.lower(path)
    score: Column = F.lit(0)
    for terms in filter(None, (sorted(search_terms(w, False)) for w in words)):
        has = [F.lit(False)] * 3
        for t in terms:
            has = [h | x.contains(t) for h, x in zip(has, (name, folder, low), strict=True)]
        score = score + F.when(has[0], 10).when(has[1], 5).when(has[2], 3).otherwise(0)
    return score if is_test_query(query) else score - F.when(is_test_file(path), 15).otherwise(0)


def search(nodes: DataFrame, raw: str, limit: int = 100, offset: int = 0, kinds: list[str] | None = None, languages: list[str] | None = None, project: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """nodes with a ``score``, the best first.

    Candidates come from ranked search, failing that from search within names, failing that from near names; symbols whose name is one of the words are
    always among them. Kind, name and path then add to the score, and path: and name: filters (any of each) are the last step.
    """
    q = parse_query(raw)
    kinds, languages = sorted({*(kinds or []), *q.kinds}), sorted({*(languages or []), *q.languages})
    wanted = lookup.of_kinds(nodes, kinds, languages)
    if q.text:
        found = search_fts(nodes, q.text, kinds, languages, limit, offset)
        if len(q.text) > 1 and found.isEmpty():
            found = like(wanted, q.text).orderBy(F.desc("score"), F.length("name"), "name", "id").offset(offset).limit(limit)
            if len(q.text) > 2 and found.isEmpty():
                found = fuzzy_nodes(nodes, wanted, q.text, limit).orderBy("distance", "name", "id").limit(limit).drop("distance")
        words = [w.lower() for w in q.text.split() if len(w) > 1]
        top = found.agg(F.max("score").alias("score"))
        exact = nodes.where(F.lower("name").isin(words)).join(found.select("id"), "id", "left_anti").select(*nodes.columns).crossJoin(F.broadcast(top)).where("score IS NOT NULL")
        found = found.select(*nodes.columns, "score").unionByName(exact)
    else:
        found = wanted.orderBy("name", "id").limit(5 * limit).withColumn("score", F.lit(1.0))
    asked = q.text or raw
    if asked:
        found = found.withColumn("score", F.col("score") + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), asked, project) + name_bonus(F.col("name"), asked))
        found = found.orderBy(F.desc("score"), "id").limit(limit)
    for column, parts in (("file_path", q.paths), ("name", q.names)):
        if parts:
            found = found.where(" OR ".join("contains(lower({0}), '{1}')".format(column, p.lower().replace("\\", "\\\\").replace("'", "\\'")) for p in parts))
    return found


def by_exact_names(nodes: DataFrame, names: list[str], limit: int = 50, kinds: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """nodes named as one of names, case aside, with a ``score``: 1, and 20 more in files that have a name which under ten files have.

    Of a name's symbols (the first of them, by id, three times its share of the limit or 50) those with the best scores stay, its share of the limit or eight.
    """
    if not names:
        return nodes.limit(0).withColumn("score", F.lit(0.0))
    each = max(8, limit // len(names))
    low = [n.lower() for n in dict.fromkeys(names)]
    order = F.array_position(F.array(*[F.lit(n) for n in low]), F.lower("name"))
    hits = nodes.where(F.lower("name").isin(low)).withColumn("_name", F.lower("name"))
    spread = (hits.where(F.col("kind").isin(kinds)) if kinds else hits).groupBy("_name").agg(F.countDistinct("file_path").alias("_files")).where("_files < 10")
    telling = hits.where(F.col("kind").isin(kinds)) if kinds else hits
    telling = telling.join(spread, "_name", "left_semi").select(F.col("file_path").alias("_telling")).distinct()
    w = Window.partitionBy("_name")
    first = lookup.of_kinds(hits, kinds, languages).withColumn("_n", F.row_number().over(w.orderBy("id"))).where(F.col("_n") <= max(3 * each, 50))
    scored = first.join(telling, F.col("file_path") == F.col("_telling"), "left").withColumn("score", F.lit(1.0) + F.when(F.col("_telling").isNotNull(), 20.0).otherwise(0.0))
    best = scored.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("_n") <= each)
    return best.orderBy(F.desc("score"), order, "id").limit(limit).select(*nodes.columns, "score")


def search_claims(claims: DataFrame, text: str, claim_type: str | None = None, limit: int = 20) -> DataFrame:
    """(id, claim_type, claim_text, score) of claims that have any of the words of text in any form that shares their stem, the best first."""
    phrases = [[porter(w) for w in p] for p in match_terms(text)]
    where = F.col("claim_type") == claim_type if claim_type else None
    if not phrases:
        return claims.limit(0).select("id", "claim_type", "claim_text", F.lit(0.0).alias("score"))
    counts = stem_counts("claim_text", phrases)
    hits = [F.col("_c")[f"n{k}"] for k in range(len(phrases))]
    counted = claims.select("id", "claim_type", "claim_text", counts.alias("_c")).select("id", "claim_type", "claim_text", F.col("_c.size").alias("_size"), *[h.alias(f"_n{k}") for k, h in enumerate(hits)], *[h.cast("double").alias(f"_f{k}") for k, h in enumerate(hits)])
    return _scored(counted, len(phrases), where).orderBy(F.desc("score"), "id").limit(limit).select("id", "claim_type", "claim_text", "score")
