"""Queries of the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import graph
from tidepool.operators.lineage import written
from tidepool.plans import views as V
from tidepool.plans.registry import query

_EDGE = "source_id, edge_type, target_id"


def _edges(spark, sf_dir):
    return V.part_edges(spark, sf_dir)


def _places(spark, sf_dir):
    """Regions, nations, customers and suppliers as one graph, each pointing to where it belongs and back."""
    t = lambda name: V.table(spark, sf_dir, name)
    nodes = graph.union_all(
        [
            t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("entity_type")),
            t("nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type")),
            t("supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type")),
        ]
    )
    links = graph.union_all(
        [
            t("nation").select((F.col("n_nationkey") + 100).cast("long").alias("source_id"), F.lit("in").alias("edge_type"), F.col("n_regionkey").cast("long").alias("target_id")),
            t("nation").select(F.col("n_regionkey").cast("long").alias("source_id"), F.lit("has").alias("edge_type"), (F.col("n_nationkey") + 100).cast("long").alias("target_id")),
            t("supplier").select((F.col("s_nationkey") + 100).cast("long").alias("source_id"), F.lit("has").alias("edge_type"), (F.col("s_suppkey") + 1_000_000).alias("target_id")),
            t("customer").select((F.col("c_nationkey") + 100).cast("long").alias("source_id"), F.lit("serves").alias("edge_type"), (F.col("c_custkey") + 5_000_000).alias("target_id")),
        ]
    )
    return nodes, links


_PLACES = """nodes AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'region' AS entity_type FROM region
        UNION ALL SELECT n_nationkey + 100, n_name, 'nation' FROM nation UNION ALL SELECT s_suppkey + 1000000, s_name, 'supplier' FROM supplier),
    links AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS source_id, 'in' AS edge_type, CAST(n_regionkey AS BIGINT) AS target_id FROM nation
        UNION ALL SELECT n_regionkey, 'has', n_nationkey + 100 FROM nation UNION ALL SELECT s_nationkey + 100, 'has', s_suppkey + 1000000 FROM supplier
        UNION ALL SELECT c_nationkey + 100, 'serves', c_custkey + 5000000 FROM customer)"""
_REACH = """walk AS (SELECT id, 0 AS depth FROM nodes WHERE id = 107
        UNION ALL SELECT DISTINCT l.target_id, w.depth + 1 FROM walk w JOIN links l ON l.source_id = w.id JOIN nodes n ON n.id = l.target_id WHERE w.depth < 4),
    reach AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@query(f"WITH {V.EDGES} SELECT {_EDGE}, valid_from FROM edges WHERE source_id = 17")
def edges_from(spark, sf_dir):
    return graph.edges_from(_edges(spark, sf_dir), 17).select("source_id", "edge_type", "target_id", "valid_from")


@query(f"WITH {V.EDGES} SELECT {_EDGE} FROM edges WHERE source_id = 17 AND edge_type = 'related_to'")
def edges_from_typed(spark, sf_dir):
    return graph.edges_from(_edges(spark, sf_dir), 17, "related_to").select("source_id", "edge_type", "target_id")


@query(f"WITH {V.EDGES} SELECT {_EDGE} FROM edges WHERE target_id = 23")
def edges_to(spark, sf_dir):
    return graph.edges_to(_edges(spark, sf_dir), 23).select("source_id", "edge_type", "target_id")


@query(f"WITH {V.EDGES} SELECT {_EDGE} FROM edges WHERE source_id % 50 = 1 OR target_id % 50 = 1")
def edges_touching(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    ids = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).where("id % 50 = 1")
    return graph.edges_touching(edges, ids).select("source_id", "edge_type", "target_id")


@query(f"WITH {V.ENTITIES} SELECT id, name, entity_type, array_to_string(observations, '|') AS observations FROM entities WHERE id = 17")
def entity_by_id(spark, sf_dir):
    return V.entities(spark, sf_dir).where("id = 17").select("id", "name", "entity_type", F.array_join("observations", "|").alias("observations"))


_AT, _KNOWN = V.START + 100 * 24 * V.HOUR, V.START + 150 * 24 * V.HOUR


@query(
    f"WITH {V.EDGES} SELECT {_EDGE}, valid_from, valid_to FROM edges WHERE valid_from <= {_AT} AND (valid_to = 0 OR valid_to > {_AT}) AND created_at <= {_KNOWN} AND (expired_at = 0 OR expired_at > {_KNOWN})"
)
def edges_as_of(spark, sf_dir):
    return graph.edges_as_of(_edges(spark, sf_dir), _AT, _KNOWN).select("source_id", "edge_type", "target_id", "valid_from", "valid_to")


@query(f"WITH RECURSIVE {_PLACES}, {_REACH} SELECT id, CAST(depth AS INTEGER) AS depth FROM reach")
def bfs(spark, sf_dir):
    return graph.reach(*_places(spark, sf_dir), 107, 4)


@query(
    f"WITH RECURSIVE {_PLACES}, {_REACH}, n AS (SELECT * FROM reach WHERE depth <= 3 ORDER BY depth, id LIMIT 200)"
    " SELECT l.source_id, l.edge_type, l.target_id FROM links l JOIN n ON l.source_id = n.id ORDER BY n.depth, l.source_id, l.edge_type, l.target_id LIMIT 500"
)
def entity_graph_edges(spark, sf_dir):
    return graph.neighbourhood(*_places(spark, sf_dir), 107, 3)[1].select("source_id", "edge_type", "target_id")


@query(f"WITH RECURSIVE {_PLACES}, {_REACH} SELECT r.id, n.name, n.entity_type, CAST(r.depth AS INTEGER) AS depth FROM reach r JOIN nodes n USING (id) WHERE depth <= 3 ORDER BY r.depth, r.id LIMIT 200")
def entity_graph_nodes(spark, sf_dir):
    return graph.neighbourhood(*_places(spark, sf_dir), 107, 3)[0].select("id", "name", "entity_type", "depth")


_IDS = "ids AS (SELECT p_partkey AS id FROM part UNION SELECT doc_id FROM documents)"


def _ids(spark, sf_dir):
    return V.entities(spark, sf_dir).select("id").union(V.memories(spark, sf_dir).select("id"))


@query(f"WITH {V.EDGES}, {_IDS} SELECT {_EDGE} FROM edges WHERE source_id NOT IN (SELECT id FROM ids) OR target_id NOT IN (SELECT id FROM ids)")
def orphan_edges(spark, sf_dir):
    return graph.orphans(_edges(spark, sf_dir), _ids(spark, sf_dir)).select("source_id", "edge_type", "target_id")


@query(f"WITH {V.EDGES}, {_IDS} SELECT edge_type, count(*) AS n FROM edges WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids) GROUP BY edge_type")
def pruned_edges(spark, sf_dir):
    return graph.without_orphans(_edges(spark, sf_dir), _ids(spark, sf_dir)).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.EDGES} SELECT {_EDGE} FROM edges WHERE source_id % 7 <> 0 AND target_id % 7 <> 0")
def cascade_delete(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    gone = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).where("id % 7 = 0")
    return graph.delete_entities(V.entities(spark, sf_dir), edges, gone)[1].select("source_id", "edge_type", "target_id")


_RESOLVED = f"""{V.ENTITIES}, keyed AS (SELECT *, lower(trim(name))[1:255] AS k, len(observations) AS n FROM entities),
    ranked AS (SELECT id, k, entity_type, observations, first_value(id) OVER (PARTITION BY k, entity_type ORDER BY n DESC, id) AS canonical_id FROM keyed)"""


@query(f"WITH {_RESOLVED} SELECT id, canonical_id FROM ranked")
def resolve_entities(spark, sf_dir):
    return graph.resolution(V.entities(spark, sf_dir))


@query(
    f"""WITH {_RESOLVED}, more AS (SELECT canonical_id AS id, flatten(list(observations ORDER BY id)) AS m FROM ranked WHERE id <> canonical_id GROUP BY canonical_id),
    own AS (SELECT r.id, r.observations, coalesce(m, []) AS m FROM ranked r LEFT JOIN more USING (id) WHERE r.id = r.canonical_id)
    SELECT id, array_to_string(list_concat(observations, list_transform(list_filter(list_zip(m, range(1, len(m) + 1)), lambda p: NOT list_contains(observations, p[1]) AND list_position(m, p[1]) = p[2]), lambda p: p[1])), '|') AS observations FROM own"""
)
def resolved_observations(spark, sf_dir):
    return graph.resolved(V.entities(spark, sf_dir)).select("id", F.array_join("observations", "|").alias("observations"))


@query(
    f"""WITH {_RESOLVED}, {V.EDGES} SELECT DISTINCT coalesce(s.canonical_id, e.source_id) AS source_id, edge_type, coalesce(t.canonical_id, e.target_id) AS target_id
    FROM edges e LEFT JOIN ranked s ON s.id = e.source_id LEFT JOIN ranked t ON t.id = e.target_id WHERE coalesce(s.canonical_id, e.source_id) <> coalesce(t.canonical_id, e.target_id)"""
)
def repoint_edges(spark, sf_dir):
    return graph.repointed(_edges(spark, sf_dir), graph.resolution(V.entities(spark, sf_dir)))


# names are the second words of documents; records whose id is divisible by 5 are linked already.
# Names of ASCII letters and digits alone are whole runs of them, so SQL needs the expression only for the others
_NAMES_SQL = f"{V.MEMORIES}, named AS (SELECT min(id) + 1000000 AS id, name FROM (SELECT id, regexp_extract_all(content, '[\\p{{L}}\\p{{N}}]+')[2] AS name FROM memories) WHERE name IS NOT NULL GROUP BY name)"


def _named(spark, sf_dir):
    word = F.regexp_extract("content", r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+[^\p{L}\p{N}]+([\p{L}\p{N}]+)", 1)
    own = V.memories(spark, sf_dir).select("id", word.alias("name"))
    return own.where(F.col("name") != "").groupBy("name").agg((F.min("id") + 1_000_000).alias("id"))


@query(
    rf"""WITH {_NAMES_SQL}, words AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS w FROM memories),
    pairs AS (SELECT n.id AS source_id, w.id AS target_id FROM named n JOIN words w ON w.w = lower(n.name) WHERE octet_length(encode(n.name)) >= 3
        UNION SELECT n.id, m.id FROM (SELECT * FROM named WHERE octet_length(encode(name)) >= 3 AND NOT regexp_full_match(lower(name), '[a-z0-9]+')) n JOIN memories m
        ON regexp_matches(lower(m.content), '(^|[^A-Za-z0-9])' || lower(n.name) || '($|[^A-Za-z0-9])'))
    SELECT source_id, 'mentioned_in' AS edge_type, target_id FROM pairs WHERE target_id % 5 <> 0"""
)
def link_entities(spark, sf_dir):
    named, memories = written(_named(spark, sf_dir), "names"), V.memories(spark, sf_dir)
    known = graph.mentions(named, memories.where("id % 5 = 0")).withColumn("edge_type", F.lit("mentioned_in"))
    return graph.link_mentions(named, memories, known)


@query(
    f"""WITH {V.ENTITIES}, fresh AS (SELECT id, name || ' II' AS name, updated_at + 1 AS updated_at FROM entities WHERE id % 3 = 0
        UNION ALL SELECT id, name || ' III', updated_at + 2 FROM entities WHERE id % 6 = 0 UNION ALL SELECT id + 5000000, name, updated_at FROM entities WHERE id % 9 = 0),
    latest AS (SELECT id, name, updated_at FROM fresh QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)
    SELECT * FROM latest UNION ALL SELECT id, name, updated_at FROM entities WHERE id NOT IN (SELECT id FROM latest)"""
)
def upsert_entities(spark, sf_dir):
    own = V.entities(spark, sf_dir).select("id", "name", "updated_at")
    fresh = own.where("id % 3 = 0").select("id", F.concat("name", F.lit(" II")).alias("name"), F.col("updated_at") + 1)
    fresh = fresh.union(own.where("id % 6 = 0").select("id", F.concat("name", F.lit(" III")), F.col("updated_at") + 2))
    fresh = fresh.union(own.where("id % 9 = 0").select(F.col("id") + 5_000_000, "name", "updated_at")).toDF("id", "name", "updated_at")
    return graph.upserted(own, fresh)


# where words of documents stand: pairs of two names less than 300 characters apart
@query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ \n]+'), 1) AS i FROM documents),
    m AS (SELECT doc_id, word AS name, i * 10 AS place FROM w WHERE word IN ('The', 'Of', 'And', 'La', 'Die'))
    SELECT DISTINCT a.doc_id, a.name AS a, b.name AS b FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.place > a.place AND b.place - a.place < 300 AND a.name <> b.name"""
)
def named_pairs(spark, sf_dir):
    words = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("i", "name"))
    said = words.where(F.col("name").isin("The", "Of", "And", "La", "Die")).select("doc_id", "name", ((F.col("i") + 1) * 10).alias("place"))
    return graph.named_pairs(said)
