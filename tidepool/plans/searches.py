"""Queries of keyword, vector and fused search, and of their quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import constants as C
from tidepool.functions.stemming import normal
from tidepool.functions.text import query_phrases
from tidepool.functions.vectors import norm, normalised
from tidepool.operators import hybrid, index, keyword, metrics, vector, vindex
from tidepool.operators.lineage import scratch
from tidepool.plans import views as V
from tidepool.plans.porter import stems_sql
from tidepool.plans.registry import query

WORDS, RARE, PHRASE, NAME = "the onth thre anor", "the onth zzqx anor", "of-the the-that", "small bolt ring"
TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _docs_sql(source: str, text: str) -> str:
    return f"d AS (SELECT *, {TERMS.format(text)} AS t FROM {source}), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d)"


def _count_sql(phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter(t, lambda x: x = '{phrase[0]}'))"
    same = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len(t) + 1), lambda i: {same}))"


def _scored_sql(phrases: list[list[str]], every: bool, name: str, source: str = "d") -> str:
    """BM25 of the documents that match, as a table ``name`` (id, score, ...)."""
    f = [f"f{k}" for k in range(len(phrases))]
    counts = ", ".join(f"{_count_sql(p)} AS {x}" for p, x in zip(phrases, f))
    withs = ", ".join(f"count(*) FILTER (WHERE {x} > 0) AS n_{x}" for x in f)
    idf = "greatest(ln((n - n_{0} + 0.5) / (n_{0} + 0.5)), 1e-6::DOUBLE)"
    weight = "{0} * 2.2::DOUBLE / ({0} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / a))"
    total = " + ".join(f"CASE WHEN {x} > 0 THEN {idf.format(x)} * {weight.format(x)} ELSE 0 END" for x in f)
    match = (" AND " if every else " OR ").join(f"{x} > 0" for x in f)
    return f"{name}_c AS (SELECT *, {counts} FROM {source}), {name}_n AS (SELECT {withs} FROM {name}_c), {name} AS (SELECT {name}_c.*, {total} AS score FROM {name}_c, {name}_n, s WHERE {match})"


def _keyword_sql(text: str, tier: str, source: str = "memories", content: str = "content") -> str:
    parts = [_docs_sql(source, content)]
    strict, loose = query_phrases(text, True), query_phrases(text, False)
    if tier != "or":
        parts.append(_scored_sql(strict, True, "a"))
    if tier != "and":
        parts.append(_scored_sql(loose, False, "o"))
    found = {"and": "SELECT id, score FROM a", "or": "SELECT id, score FROM o", "tiered": "SELECT id, score FROM a UNION ALL SELECT id, score FROM o WHERE NOT EXISTS (SELECT 1 FROM a)"}[tier]
    return ", ".join(parts) + f", found AS ({found})"


def _top_sql(ctes: str, k: int = 10) -> str:
    return f"WITH {ctes} SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM found ORDER BY score DESC, id LIMIT {k}"


def _keyword(spark, sf_dir, text, tier, k=10):
    docs = keyword.tokenised(V.memories(spark, sf_dir).select("id", "content")).drop("content")
    return keyword.top(keyword.search(docs, text, tier), k).select("id", "rank", F.round("score", 6).alias("score"))


@query(_top_sql(V.MEMORIES + ", " + _keyword_sql(WORDS, "or")))
def kw_or(spark, sf_dir):
    return _keyword(spark, sf_dir, WORDS, "or")


@query(_top_sql(V.MEMORIES + ", " + _keyword_sql("the of onth thre", "and")))
def kw_and(spark, sf_dir):
    return _keyword(spark, sf_dir, "the of onth thre", "and")


@query(_top_sql(V.MEMORIES + ", " + _keyword_sql("the of onth thre", "tiered")))
def kw_tiered(spark, sf_dir):
    return _keyword(spark, sf_dir, "the of onth thre", "tiered")


@query(_top_sql(V.MEMORIES + ", " + _keyword_sql(RARE, "tiered")))
def kw_tiered_fallback(spark, sf_dir):
    return _keyword(spark, sf_dir, RARE, "tiered")


@query(_top_sql(V.MEMORIES + ", " + _keyword_sql(PHRASE, "or")))
def kw_phrase(spark, sf_dir):
    return _keyword(spark, sf_dir, PHRASE, "or")


# inflected and accented words: each different term is stemmed once, then documents are lists of stems
STEMMED = "tions thred hèr anoring"
_STEMMED_DOCS = f"""words AS (SELECT DISTINCT unnest({TERMS.format("content")}) AS w FROM memories), {stems_sql("words")},
    u AS (SELECT id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT id, {TERMS.format("content")} AS x FROM memories)),
    d AS (SELECT m.id, coalesce(l.t, []) AS t FROM memories m LEFT JOIN (SELECT id, list(st ORDER BY i) AS t FROM u JOIN stems USING (w) GROUP BY id) l USING (id)),
    s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d)"""


@query(_top_sql(f"{V.MEMORIES}, {_STEMMED_DOCS}, {_scored_sql([[normal(w)] for w in STEMMED.split()], False, 'o')}, found AS (SELECT id, score FROM o)", 50))
def kw_stemmed(spark, sf_dir):
    docs = keyword.tokenised(V.memories(spark, sf_dir).select("id", "content"), stemmed=True).drop("content")
    return keyword.top(keyword.search(docs, STEMMED, "or", stemmed=True), 50).select("id", "rank", F.round("score", 6).alias("score"))


# entities: name, type and observations are searched together; the type filter comes after the cut to 2k
@query(
    f"WITH {V.ENTITIES}, "
    + _keyword_sql(NAME, "tiered", "(SELECT *, concat_ws(' ', name, entity_type, array_to_string(observations, ' ')) AS content FROM entities)")
    + ", w AS (SELECT * FROM found ORDER BY score DESC, id LIMIT 20) SELECT w.id, e.name, e.entity_type, round(w.score, 6) AS score, CAST(len(e.observations) AS INTEGER) AS observation_count"
    " FROM w JOIN entities e USING (id) WHERE e.entity_type = 'ECONOMY' ORDER BY w.score DESC, w.id LIMIT 10"
)
def kw_entity(spark, sf_dir):
    own = V.entities(spark, sf_dir).withColumn("_all", F.array_join("observations", " "))
    hits = keyword.search(keyword.tokenised(own, ["name", "entity_type", "_all"]), NAME).orderBy(F.desc("score"), "id").limit(20)
    kept = hits.where(F.col("entity_type") == "ECONOMY").orderBy(F.desc("score"), "id").limit(10)
    return kept.select("id", "name", "entity_type", F.round("score", 6).alias("score"), F.size("observations").alias("observation_count"))


_BOTH_SQL = "pool AS (SELECT id, content, 0 AS kind FROM memories UNION ALL SELECT id + 100000000, name || ' onth', 1 FROM entities)"


def _both(spark, sf_dir):
    entities = V.entities(spark, sf_dir).select((F.col("id") + 100_000_000).alias("id"), F.concat("name", F.lit(" onth")).alias("content"), F.lit(1).alias("kind"))
    return V.memories(spark, sf_dir).select("id", "content", F.lit(0).alias("kind")).unionByName(entities)


@query(
    f"WITH {V.MEMORIES}, {V.ENTITIES}, {_BOTH_SQL}, {_docs_sql('pool', 'content')}, {_scored_sql([['onth'], ['thre'], ['anor']], False, 'o')}, "
    "r AS (SELECT id, kind, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM o) SELECT id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE kind = 0 AND rank <= 100"
)
def kw_rank_with_gaps(spark, sf_dir):
    docs = keyword.tokenised(_both(spark, sf_dir)).drop("content")
    found = keyword.top(keyword.search(docs, "onth thre anor", "or"), C.RANKER_LIMIT).where("kind = 0")
    return found.select("id", "rank", F.round("score", 6).alias("score"))


# a batch: the queries are the first three terms of every 50th document
_BATCH_SQL = f"""WITH {V.MEMORIES}, {_docs_sql("memories", "content")},
    q AS (SELECT DISTINCT id AS query_id, unnest(t[1:3]) AS term FROM d WHERE id % 50 = 0),
    p AS (SELECT id, term, len(any_value(t)) AS l, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) GROUP BY id, term),
    w AS (SELECT term, count(*) AS m FROM p GROUP BY term),
    h AS (SELECT query_id, p.id, sum(greatest(ln((n - m + 0.5) / (m + 0.5)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))) AS score
          FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY query_id, p.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM h)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"""


def _indexed(spark, sf_dir):
    """An index of all documents, written and read again."""
    made = index.KeywordIndex(spark, scratch(spark, "index"))
    made.append(keyword.tokenised(V.memories(spark, sf_dir).select("id", "content")).select("id", F.lit(0).alias("kind"), "tokens"))
    return made


@query(_BATCH_SQL)
def kw_batch(spark, sf_dir):
    few = keyword.tokenised(V.memories(spark, sf_dir).where("id % 50 = 0").select("id", "content"))
    asked = few.select(F.col("id").alias("query_id"), F.explode(F.slice("tokens", 1, 3)).alias("term"))
    found = _indexed(spark, sf_dir).search_batch(asked)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _from_index(spark, sf_dir, text, tier):
    return keyword.top(_indexed(spark, sf_dir).search(text, tier), 10).select("id", "rank", F.round("score", 6).alias("score"))


@query(_top_sql(V.MEMORIES + ", " + _keyword_sql(WORDS, "tiered")))
def kw_index_tiered(spark, sf_dir):
    return _from_index(spark, sf_dir, WORDS, "tiered")


@query(_top_sql(V.MEMORIES + ", " + _keyword_sql(PHRASE, "or")))
def kw_index_phrase(spark, sf_dir):
    return _from_index(spark, sf_dir, PHRASE, "or")


# ---------------------------------------------------------------- vectors

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
_VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = {0})"


def _distance_sql(a: str, b: str) -> str:
    return f"greatest(0.0::DOUBLE, 1 - {_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)})))"


def _nearest_sql(vec_id: int, k: int, distance: str) -> str:
    return f"WITH {_VEC.format(vec_id)}, n AS (SELECT id, round({distance}, 6) AS distance FROM v, q) SELECT id, distance FROM n ORDER BY distance, id LIMIT {k}"


def _nearest(spark, sf_dir, metric, vec_id=7, k=10):
    found = vector.nearest(V.vectors(spark, sf_dir), V.query_vector(spark, sf_dir, vec_id), k, metric)
    return found.select("id", F.round("distance", 6).alias("distance"))


@query(_nearest_sql(7, 10, _distance_sql("e", "qe")))
def knn_cosine(spark, sf_dir):
    return _nearest(spark, sf_dir, "cosine")


@query(_nearest_sql(7, 10, "sqrt(list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"))
def knn_l2(spark, sf_dir):
    return _nearest(spark, sf_dir, "l2")


@query(_nearest_sql(7, 10, "-" + _DOT.format("e", "qe")))
def knn_dot(spark, sf_dir):
    return _nearest(spark, sf_dir, "dot")


def _vector_index(spark, sf_dir):
    """An index of all vectors, and as queries those with an id divisible by 50."""
    own = V.vectors(spark, sf_dir)
    return vindex.build(own, scratch(spark, "vectors")), own.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("v"))


@query(
    f"""WITH {_VEC.format(0)}, d AS (SELECT a.id AS query_id, b.id, round({_distance_sql("a.e", "b.e")}, 6) AS distance FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM r WHERE rank <= 10"""
)
def knn_index_exact(spark, sf_dir):
    """Every cell that can hold one of the nearest is probed."""
    index, asked = _vector_index(spark, sf_dir)
    return index.search(asked, exact=True)


@query()
def knn_index_recall(spark, sf_dir):
    """What the default number of probes finds of the nearest, for each query."""
    index, asked = _vector_index(spark, sf_dir)
    return vindex.recall(*index.search_twice(asked))


@query(f"WITH {_VEC.format(0)}, m AS (SELECT id, list_transform(e, lambda x: x * 3) AS e FROM v) SELECT id, round(sqrt({_DOT.format('e', 'e')}), 6) AS norm, round(e[1] / sqrt({_DOT.format('e', 'e')}), 6) AS first FROM m")
def vectors_normalised(spark, sf_dir):
    own = V.vectors(spark, sf_dir).select("id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    return own.select("id", F.round(norm("e"), 6).alias("norm"), F.round(F.element_at(normalised("e"), 1), 6).alias("first"))


_SEMANTIC = f"""WITH {V.MEMORIES}, {V.CHUNKS}, {_VEC.format(7)},
    n AS (SELECT id, {_distance_sql("e", "qe")} AS distance FROM v, q ORDER BY distance, id LIMIT 30),
    p AS (SELECT coalesce(c.parent_id, n.id) AS id, min(distance) AS distance FROM n LEFT JOIN chunks c ON c.id = n.id GROUP BY 1)
    SELECT p.id, m.tier, round(1 - distance, 6) AS score FROM p JOIN memories m USING (id)"""


@query(_SEMANTIC)
def semantic_search(spark, sf_dir):
    found = vector.semantic(V.vectors(spark, sf_dir), V.chunks(spark, sf_dir), V.memories(spark, sf_dir), V.query_vector(spark, sf_dir, 7), 30)
    return found.select("id", "tier", F.round("score", 6).alias("score"))


_NEAR = 0.72


@query(
    f"""WITH RECURSIVE {_VEC.format(0)}, u AS (SELECT id, list_transform(e, lambda x: x / sqrt({_DOT.format("e", "e")})) AS e FROM v),
    p AS (SELECT a.id, min(b.id) AS parent FROM u a JOIN u b ON b.id < a.id AND 1 - {_DOT.format("a.e", "b.e")} < {_NEAR}::DOUBLE GROUP BY a.id),
    l AS (SELECT v.id, coalesce(p.parent, v.id) AS parent FROM v LEFT JOIN p USING (id)),
    r AS (SELECT id, id AS cluster FROM l WHERE id = parent UNION ALL SELECT l.id, r.cluster FROM l JOIN r ON l.parent = r.id WHERE l.id <> l.parent)
    SELECT id, cluster FROM r"""
)
def greedy_clusters(spark, sf_dir):
    return vector.greedy_clusters(V.vectors(spark, sf_dir), _NEAR)


# ---------------------------------------------------------------- fusion

_HYBRID_QUERY, _HYBRID_VECTOR = "onth zzqx thre anor", 7
_VECTOR_SQL = f"""vn AS (SELECT id, {_distance_sql("e", "qe")} AS distance FROM v, q ORDER BY distance, id LIMIT 100),
    vr AS (SELECT id, 1 - distance AS score, row_number() OVER (ORDER BY distance, id) AS rank FROM vn),
    vp AS (SELECT coalesce(c.parent_id, vr.id) AS id, min(rank) AS rank, max(score) AS score FROM vr LEFT JOIN chunks c ON c.id = vr.id GROUP BY 1)"""
_KEY_SQL = f"""{_docs_sql("pool", "content")}, {_scored_sql([["onth"], ["thre"], ["anor"]], False, "o")},
    kr AS (SELECT id, kind, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM o), kp AS (SELECT id, rank, score FROM kr WHERE kind = 0 AND rank <= 100)"""
_GRAPH_SQL = f"""ge AS (SELECT id, row_number() OVER (ORDER BY d, id) AS seed FROM (SELECT id, {_distance_sql("e", "qe")} AS d FROM v, q WHERE id % 10 = 3 ORDER BY d, id LIMIT 5)),
    edge AS (SELECT e.vec_id AS source_id, 'in' || CAST(d.doc_id % 3 AS VARCHAR) AS edge_type, d.doc_id AS target_id FROM embeddings e JOIN documents d ON d.doc_id % 97 = e.vec_id % 97 WHERE e.vec_id % 10 = 3),
    gf AS (SELECT target_id AS id, min(ROW(seed, edge_type)) AS m FROM ge JOIN edge ON ge.id = edge.source_id GROUP BY target_id),
    go AS (SELECT id, m[1] AS seed, row_number() OVER (ORDER BY m[1], m[2], id) AS rank FROM gf), gp AS (SELECT id, rank, 1::DOUBLE / seed AS score FROM go WHERE rank <= 100)"""
_ALL_SQL = f"WITH {V.MEMORIES}, {V.ENTITIES}, {V.CHUNKS}, {_BOTH_SQL}, {_VEC.format(_HYBRID_VECTOR)}, {_VECTOR_SQL}, {_KEY_SQL}, {_GRAPH_SQL}"


def _vector_part(spark, sf_dir):
    return hybrid.vector_ranker(V.vectors(spark, sf_dir), V.chunks(spark, sf_dir), V.query_vector(spark, sf_dir, _HYBRID_VECTOR))


def _keyword_part(spark, sf_dir):
    return hybrid.keyword_ranker(keyword.tokenised(_both(spark, sf_dir)).drop("content"), _HYBRID_QUERY)


def _graph_part(spark, sf_dir):
    """Every tenth vector is an entity; it points to documents that agree with it modulo 97."""
    seeds = V.vectors(spark, sf_dir).where("id % 10 = 3")
    docs = V.table(spark, sf_dir, "documents").select("doc_id")
    kind = F.concat(F.lit("in"), (F.col("doc_id") % 3).cast("string"))
    edges = seeds.select(F.col("id").alias("source_id"), (F.col("id") % 97).alias("m")).join(docs.withColumn("m", F.col("doc_id") % 97), "m")
    edges = edges.select("source_id", kind.alias("edge_type"), F.col("doc_id").alias("target_id"))
    return hybrid.graph_ranker(seeds, edges, V.query_vector(spark, sf_dir, _HYBRID_VECTOR))


@query(_ALL_SQL + " SELECT id, CAST(rank AS INTEGER) AS rank, score FROM gp")
def graph_ranker(spark, sf_dir):
    return _graph_part(spark, sf_dir)


def _fused_sql(parts: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT id, rank, score, '{name}' AS ranker FROM {t}" for name, t in parts.items())
    own = ", ".join(f"round(coalesce(max(score) FILTER (WHERE ranker = '{name}'), 0), 6) AS {name}_score" for name in parts)
    return (
        f"{_ALL_SQL}, f AS (SELECT id, sum(1::DOUBLE / (60 + rank)) AS score, count(*) AS rankers, {own} FROM ({rows}) GROUP BY id)"
        f" SELECT f.id, round(f.score, 9) AS score, rankers, {', '.join(f'{n}_score' for n in parts)}, tier FROM f JOIN memories m USING (id) ORDER BY round(f.score, 9) DESC, f.id LIMIT 20"
    )


def _fused(spark, sf_dir, parts):
    fused = hybrid.fuse(parts).withColumn("score", F.round("score", 9))
    found = hybrid.results(fused, V.memories(spark, sf_dir).select("id", "tier"), 20)
    return found.select("id", "score", "rankers", *[F.round(f"{n}_score", 6).alias(f"{n}_score") for n in parts], "tier")


@query(_fused_sql({"vector": "vp", "keyword": "kp", "graph": "gp"}))
def rrf_hybrid(spark, sf_dir):
    return _fused(spark, sf_dir, {"vector": _vector_part(spark, sf_dir), "keyword": _keyword_part(spark, sf_dir), "graph": _graph_part(spark, sf_dir)})


@query(_fused_sql({"keyword": "kp"}))
def rrf_keyword_only(spark, sf_dir):
    return _fused(spark, sf_dir, {"keyword": _keyword_part(spark, sf_dir)})


@query(_fused_sql({"vector": "vp", "keyword": "kp"}))
def rrf_without_graph(spark, sf_dir):
    return _fused(spark, sf_dir, {"vector": _vector_part(spark, sf_dir), "keyword": _keyword_part(spark, sf_dir)})


@query(f"{_ALL_SQL}, f AS (SELECT id FROM vp UNION SELECT id FROM kp UNION SELECT id FROM gp) SELECT count(*) AS found, count(*) > 20 AS truncated FROM f")
def rrf_truncated(spark, sf_dir):
    parts = {"vector": _vector_part(spark, sf_dir), "keyword": _keyword_part(spark, sf_dir), "graph": _graph_part(spark, sf_dir)}
    return hybrid.truncated(hybrid.fuse(parts), 20)


@query(f"WITH {V.CHUNKS} SELECT id, parent_id FROM chunks WHERE parent_id = 48")
def passages_of(spark, sf_dir):
    return V.chunks(spark, sf_dir).where("parent_id = 48").select("id", "parent_id")


# ---------------------------------------------------------------- quality

_RESULTS_SQL = "res AS (SELECT doc_id // 20 AS query_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY toxic, doc_id) AS rank, quality AS relevant FROM labels)"


def _results(spark, sf_dir):
    own = V.table(spark, sf_dir, "labels").withColumn("query_id", F.floor(F.col("doc_id") / 20))
    return own.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("toxic", "doc_id")).alias("rank"), F.col("quality").alias("relevant"))


@query(
    f"""WITH {_RESULTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevant DESC, rank) AS best FROM res WHERE rank <= 5),
    g AS (SELECT query_id, max(relevant) AS hit, sum(relevant / log2(rank + 1)) AS dcg, sum(relevant / log2(best + 1)) AS idcg FROM t GROUP BY query_id)
    SELECT query_id, CAST(hit AS INTEGER) AS hit, round(dcg, 6) AS dcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM g"""
)
def retrieval_metrics(spark, sf_dir):
    found = metrics.retrieval(_results(spark, sf_dir), 5)
    return found.select("query_id", "hit", F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


@query(
    f"""WITH {_RESULTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevant DESC, rank) AS best FROM res WHERE rank <= 5),
    g AS (SELECT query_id, max(relevant) AS hit, sum(relevant / log2(rank + 1)) AS dcg, sum(relevant / log2(best + 1)) AS idcg FROM t GROUP BY query_id)
    SELECT query_id % 4 AS ability, count(*) AS n, round(avg(hit), 6) AS recall, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg FROM g GROUP BY 1"""
)
def retrieval_by_ability(spark, sf_dir):
    own = metrics.retrieval(_results(spark, sf_dir), 5).groupBy((F.col("query_id") % 4).alias("ability"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


# of each run of 20 labelled rows, the first 12 in rank order are what a search gave; each has scores of three rankers
_FOUND_SQL = f"{_RESULTS_SQL}, own AS (SELECT doc_id, doc_id // 20 AS query_id, quality AS relevant, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY toxic, doc_id) AS rank FROM labels), got AS (SELECT * FROM own WHERE rank <= 12)"


def _found(spark, sf_dir):
    own = V.table(spark, sf_dir, "labels").withColumn("query_id", F.floor(F.col("doc_id") / 20))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("toxic", "doc_id"))
    return own.select("query_id", F.col("doc_id").alias("id"), F.col("quality").alias("relevant"), place.alias("rank"))


@query(f"WITH {_FOUND_SQL} SELECT query_id, round(count(*) FILTER (WHERE rank <= 12) / count(*), 6) AS session_recall FROM own WHERE relevant = 1 GROUP BY query_id")
def session_recall(spark, sf_dir):
    own = _found(spark, sf_dir)
    return metrics.session_recall(own.where("rank <= 12"), own.where("relevant = 1")).select("query_id", F.round("session_recall", 6).alias("session_recall"))


_PLAIN_SQL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


# the answer to a run of 20 documents is the text of the benchmark item of its number
@query(
    f"""WITH t AS (SELECT doc_id // 20 AS query_id, string_agg(coalesce(text, ''), ' ' ORDER BY doc_id) AS t FROM documents GROUP BY 1),
    a AS (SELECT item_id AS query_id, {_PLAIN_SQL.format("text")} AS a FROM benchmark)
    SELECT query_id, coalesce(a <> '' AND contains({_PLAIN_SQL.format("t")}, a), false) AS answer_found FROM a LEFT JOIN t USING (query_id)"""
)
def answers_found(spark, sf_dir):
    own = V.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("query_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    return metrics.answers_found(own, V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer")))


@query(
    f"""WITH {_FOUND_SQL}, x AS (SELECT query_id, doc_id % 7 / 7 AS v, CAST(doc_id % 3 AS DOUBLE) AS k, doc_id % 5 / 5 AS g FROM got)
    SELECT query_id, count(*) AS results, count(*) FILTER (WHERE v > 0) AS has_vector, count(*) FILTER (WHERE k > 0) AS has_keyword, count(*) FILTER (WHERE g > 0) AS has_graph,
        round(coalesce(avg(v) FILTER (WHERE v > 0), 0), 4) AS avg_vector, round(coalesce(avg(k) FILTER (WHERE k > 0), 0), 4) AS avg_keyword, round(coalesce(avg(g) FILTER (WHERE g > 0), 0), 4) AS avg_graph
    FROM x GROUP BY query_id"""
)
def ranker_contributions(spark, sf_dir):
    own = _found(spark, sf_dir).where("rank <= 12")
    scores = own.select("query_id", (F.col("id") % 7 / 7).alias("vector_score"), (F.col("id") % 3).cast("double").alias("keyword_score"), (F.col("id") % 5 / 5).alias("graph_score"))
    return metrics.ranker_contributions(scores)


@query(
    f"""WITH {_FOUND_SQL}, c AS (SELECT query_id, query_id % 4 AS ability, CASE WHEN rank <= 12 THEN rank END AS rank FROM own WHERE relevant = 1),
    m AS (SELECT *, coalesce(min(rank) OVER (PARTITION BY query_id), 6) > 5 AS missed FROM c)
    SELECT ability, count(DISTINCT query_id) AS queries, count(DISTINCT query_id) FILTER (WHERE missed) AS missed, count(*) FILTER (WHERE missed AND rank IS NULL) AS not_retrieved,
        count(*) FILTER (WHERE missed AND rank > 5) AS ranked_low, list_sort(list(rank) FILTER (WHERE missed AND rank > 5))[count(*) FILTER (WHERE missed AND rank > 5) // 2 + 1] AS median_rank,
        min(rank) FILTER (WHERE missed AND rank > 5) AS least_rank, max(rank) FILTER (WHERE missed AND rank > 5) AS most_rank FROM m GROUP BY ability"""
)
def miss_analysis(spark, sf_dir):
    own = _found(spark, sf_dir).where("relevant = 1")
    return metrics.misses(own.select("query_id", (F.col("query_id") % 4).alias("ability"), F.when(F.col("rank") <= 12, F.col("rank")).alias("rank")), "ability")


@query(
    "SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY event_type"
)
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(V.table(spark, sf_dir, "events"), "event_type", "value")
