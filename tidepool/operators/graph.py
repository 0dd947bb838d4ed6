"""The entity graph: neighbours, traversal, orphans, linking and resolving."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.text import normalised_name
from tidepool.operators.lineage import checkpointed, written

#: Characters of texts whose words are told together.
TEXT = 1 << 22
RUN, WORD = re.compile("[a-z0-9]+"), re.compile("[a-z0-9\x80-\U0010ffff]+")
EDGE = ["source_id", "edge_type", "target_id"]


def edges_from(edges: DataFrame, source, edge_type: str | None = None) -> DataFrame:
    found = edges.where(F.col("source_id") == source)
    return found if edge_type is None else found.where(F.col("edge_type") == edge_type)


def edges_to(edges: DataFrame, target) -> DataFrame:
    return edges.where(F.col("target_id") == target)


def _marked(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with ``_s`` and ``_t``: 1 where the source, the target is in ``ids``, else null. Edges are read once."""
    known = ids.select("id").distinct().withColumn("_in", F.lit(1))
    left = known.select(F.col("id").alias("_sid"), F.col("_in").alias("_s"))
    right = known.select(F.col("id").alias("_tid"), F.col("_in").alias("_t"))
    both = edges.join(left, F.col("source_id") == F.col("_sid"), "left").join(right, F.col("target_id") == F.col("_tid"), "left")
    return both.drop("_sid", "_tid")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with a source or a target in ``ids`` (id): two equi-joins instead of one with OR."""
    return _marked(edges, ids).where("_s = 1 or _t = 1").drop("_s", "_t")


def edges_as_of(edges: DataFrame, domain_ms: int, known_ms: int) -> DataFrame:
    """Edges valid at one time as known at another; unset bounds (0 or null) are open."""
    opened = F.coalesce(F.col("valid_from"), F.lit(0)) <= domain_ms
    unset = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    holds = unset("valid_to") | (F.col("valid_to") > domain_ms)
    known = (F.col("created_at") <= known_ms) & (unset("expired_at") | (F.col("expired_at") > known_ms))
    return edges.where(opened & holds & known)


def reach(entities: DataFrame, edges: DataFrame, start, depth: int, most_nodes: int | None = None) -> DataFrame:
    """(id, depth): entities on out-edges from ``start``, each at its least depth; ids that are no entities are not passed through.

    One join a level, cut by a checkpoint; levels are bounded (1 to 5), so no loop runs away.
    """
    depth = min(max(depth, 1), 5)
    level = entities.where(F.col("id") == start).select("id").distinct().withColumn("depth", F.lit(0))
    seen = level
    hops = edges.select("source_id", "target_id")
    for step in range(1, depth + 1):
        ahead = level.join(hops, level.id == hops.source_id).select(F.col("target_id").alias("id")).distinct()
        level = ahead.join(entities.select("id"), "id", "left_semi").join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(step))
        level = checkpointed(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen if most_nodes is None else seen.orderBy("depth", "id").limit(most_nodes)


def neighbourhood(entities: DataFrame, edges: DataFrame, start, depth: int, most_nodes: int = 200, most_edges: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, entity_type, depth) and the edges that leave them."""
    nodes = reach(entities, edges, start, depth, most_nodes).join(entities.select("id", "name", "entity_type"), "id")
    leaving = edges.join(nodes.select(F.col("id").alias("source_id"), "depth"), "source_id").orderBy("depth", "source_id", "edge_type", "target_id").limit(most_edges)
    return nodes, leaving.drop("depth")


def orphans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end that is in no table; ``ids`` (id) are all that exist."""
    return _marked(edges, ids).where("_s is null or _t is null").drop("_s", "_t")


def without_orphans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    known = ids.select("id").distinct()
    found = edges.join(known, edges.source_id == known.id, "left_semi")
    return found.join(known, found.target_id == known.id, "left_semi")


def delete_entities(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables without some entities and without the edges at them; versions are kept elsewhere."""
    gone = ids.select("id").distinct()
    rest = edges.join(gone, edges.source_id == gone.id, "left_anti")
    return entities.join(gone, "id", "left_anti"), rest.join(gone, rest.target_id == gone.id, "left_anti")


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, lower-case text) as (w, ids): the different ASCII runs of each text, and its words with other characters, one row for each word of up to ``TEXT`` characters of texts."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        ends, low = np.cumsum([len(t or "") for t in texts]), 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXT, "right")))
            words, sizes = [], []
            for text in texts[low:high]:
                own = set(RUN.findall(text)) if text else set()
                if text and not text.isascii():
                    own.update(w for w in WORD.findall(text) if not w.isascii())
                words.extend(own)
                sizes.append(len(own))
            coded = pa.array(words, pa.string()).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), ids.take(pa.array(np.repeat(np.arange(low, high), sizes)[order])))
            yield pa.RecordBatch.from_arrays([coded.dictionary, lists], names=["w", "ids"])
            low = high


def mentions(entities: DataFrame, memories: DataFrame) -> DataFrame:
    """(source_id, target_id): entities whose name a record mentions, as whole words and whatever the case.

    Names of at least 3 bytes count; any character but ASCII letters and digits bounds a word. So a name of ASCII letters and digits is mentioned where it is a whole ASCII run of a record: runs
    move with the records that hold them, one row for each run of many records, and meet the entities of that name. A name with characters beyond ASCII but without other ASCII characters stands
    inside one word of a record, a word being a run of ASCII letters, digits and characters beyond ASCII; it is looked for in the different such words of all records, each once. Any other
    name is a candidate where its longest ASCII run (or, without one, its first character) stands, and is then looked for in the record. Joins grow with what records say, not with
    entities times records.
    """
    run = F.lit("[a-z0-9]+")
    kind = F.when(F.col("n").rlike("^[a-z0-9]+$"), "run").when(F.col("n").rlike(r"^[a-z0-9\x{80}-\x{10ffff}]+$"), "word").otherwise("text")
    named = entities.where(F.octet_length("name") >= 3).select(F.col("id").alias("source_id"), F.lower("name").alias("n")).distinct()
    named = written(named.withColumn("kind", kind), "named")
    runs = F.regexp_extract_all("n", run, F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("l"), r.alias("r")))), 1)["r"]
    wanted = named.where("kind <> 'run'").select("n", "kind").distinct().withColumn("term", F.when(F.size(runs) > 0, longest).otherwise(F.substring("n", 1, 1)))
    lowered = memories.select(F.col("id").alias("target_id"), F.lower("content").alias("c"))
    id_type = memories.schema["id"].dataType.simpleString()
    words = written(lowered.mapInArrow(_said, f"w string, ids array<{id_type}>"), "words")
    # a name of one kind is not of another, and a record has a run once: pairs repeat only where noted
    found = words.join(named.where("kind = 'run'"), words.w == named.n).select("source_id", F.explode("ids").alias("target_id"))

    edge, end = F.lit("(^|[^A-Za-z0-9])"), F.lit("($|[^A-Za-z0-9])")
    quoted = F.concat(F.lit("\\Q"), F.replace("n", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    holds = lambda c: F.contains(c, "n") & F.regexp_like(c, F.concat(edge, quoted, end))
    kinds = {r.kind for r in wanted.select("kind").distinct().collect()}  # two at most
    if "word" in kinds:
        vocabulary = words.where(F.octet_length("w") > F.length("w")).select("w").distinct()
        beyond = F.split(F.translate("w", "abcdefghijklmnopqrstuvwxyz0123456789", ""), "")
        parts = F.array_distinct(F.concat(F.regexp_extract_all("w", run, F.lit(0)), beyond))
        inside = vocabulary.select("w", F.explode(parts).alias("term")).join(wanted.where("kind = 'word'"), "term")
        known = inside.where(holds(F.col("w"))).select("w", "n").join(named, "n").select("w", "source_id").distinct()
        # several words of a record may hold one name
        found = found.unionByName(words.join(known, "w").select("source_id", F.explode("ids").alias("target_id")).distinct())
    if "text" in kinds:
        loose = wanted.where("kind = 'text'").select("n", "term")
        others = F.split(F.concat(F.translate("c", "abcdefghijklmnopqrstuvwxyz0123456789 ", ""), F.lit(" ")), "")
        terms = lowered.select("target_id", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("c", run, F.lit(0)), others))).alias("term"))
        # ids and names only move; a text is read again once, with all names that may be in it
        candidates = terms.join(loose, "term").groupBy("target_id").agg(F.collect_set("n").alias("names"))
        each = lowered.join(candidates, "target_id").select("target_id", "c", F.explode("names").alias("n"))
        found = found.unionByName(each.where(holds(F.col("c"))).join(named, "n").select("source_id", "target_id"))
    # ids of several names, or of several records, have pairs more than once
    once = named.groupBy("source_id").count().where("count > 1").isEmpty() and memories.groupBy("id").count().where("count > 1").isEmpty()
    return found if once else found.distinct()


def link_mentions(entities: DataFrame, memories: DataFrame, edges: DataFrame, edge_type: str = "mentioned_in") -> DataFrame:
    """New edges for mentions that no edge has yet: running it again adds none."""
    held = edges.where(F.col("edge_type") == edge_type).select("source_id", "target_id")
    new = mentions(entities, memories).join(held, ["source_id", "target_id"], "left_anti")
    return new.withColumn("edge_type", F.lit(edge_type)).select(*EDGE)


def resolution(entities: DataFrame) -> DataFrame:
    """(id, canonical_id): entities of one normalised name and type are one; the one with most observations, then the least id, stands for all."""
    own = entities.select("id", normalised_name("name").alias("key"), "entity_type", F.size("observations").alias("n"))
    best = own.groupBy("key", "entity_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("m")).select("key", "entity_type", F.col("m.id").alias("canonical_id"))
    same = own.key.eqNullSafe(best.key) & own.entity_type.eqNullSafe(best.entity_type)
    return own.join(best, same).select(own.id, "canonical_id")


def resolved(entities: DataFrame) -> DataFrame:
    """The canonical entities with the observations of their duplicates appended, each new one once, in id order."""
    mapping = resolution(entities)
    told = entities.join(mapping, "id").select("canonical_id", "id", (F.col("id") == F.col("canonical_id")).alias("own"), "observations")
    lists = told.where("not own").groupBy("canonical_id").agg(F.sort_array(F.collect_list(F.struct("id", "observations"))).alias("l"))
    more = lists.select(F.col("canonical_id").alias("id"), F.flatten(F.col("l.observations")).alias("more"))
    kept = entities.join(mapping.where("id = canonical_id").select("id"), "id", "left_semi").join(more, "id", "left")
    new = F.array_distinct(F.filter(F.coalesce("more", F.array().cast("array<string>")), lambda o: ~F.array_contains("observations", o)))
    return kept.withColumn("observations", F.concat("observations", new)).drop("more")


def repointed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends moved to the canonical entities; loops go, and repeats of an edge become one."""
    left = mapping.select(F.col("id").alias("source_id"), F.col("canonical_id").alias("_s"))
    right = mapping.select(F.col("id").alias("target_id"), F.col("canonical_id").alias("_t"))
    moved = edges.join(left, "source_id", "left").join(right, "target_id", "left")
    ends = moved.select(F.coalesce("_s", "source_id").alias("source_id"), "edge_type", F.coalesce("_t", "target_id").alias("target_id"))
    return ends.where("source_id <> target_id").distinct()


def upserted(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The table with rows of ``changes`` in place of those with the same key; of several changes the latest."""
    place = Window.partitionBy(key).orderBy(F.desc(order))
    latest = changes.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    return table.join(latest.select(key), key, "left_anti").unionByName(latest)


def named_pairs(mentioned: DataFrame, reach_chars: int = 300) -> DataFrame:
    """(doc_id, a, b): entities named within some characters of each other in one text; ``mentioned`` is (doc_id, name, place)."""
    frame = Window.partitionBy("doc_id").orderBy("place").rangeBetween(1, reach_chars - 1)
    after = mentioned.withColumn("near", F.collect_set("name").over(frame))
    pairs = after.select("doc_id", F.col("name").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return pairs.distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
