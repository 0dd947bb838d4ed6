"""A store of records, entities, edges, versions and passages in Parquet, with the operators of the library as its tools.

A table is a folder of generations; a generation is a folder of parts. Appending adds a part, replacing writes the next generation.
Readers take the last generation whose first part is complete, so a write that fails half-way changes nothing. Only the
names of folders are looked up on the driver, through Spark's own file systems.
"""

from __future__ import annotations

import json

import platform
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import constants as C
from tidepool.functions import dates, ids
from tidepool.functions.embedding import Embedder
from tidepool.functions.text import turn_chunks
from tidepool.operators import graph, hybrid, index, keyword, lifecycle, tables, temporal, vector
from tidepool.operators.lineage import checkpointed
from tidepool.sources import files

SCHEMAS = {
    "memories": "id string, tier string, content string, source_type string, source_id string, source_author string, tags array<string>, embedding array<float>, importance double, access_count long, created_at long, last_accessed long, entity_ids array<string>, consolidated boolean",
    "entities": "id string, name string, entity_type string, observations array<string>, embedding array<float>, created_at long, updated_at long, event_date long, importance double, access_count long, last_accessed long",
    "edges": "id string, source_id string, edge_type string, target_id string, description string, weight double, valid_from long, valid_to long, created_at long, expired_at long",
    "versions": "id string, valid_from long, updated_at long, value string",
    "chunks": "id string, parent_id string, sequence int, char_offset int, char_length int, embedding array<float>",
}
DECOYS = ("admin_reset_auth", "export_all_memories", "debug_raw_query", "set_system_config")


class InvalidInput(ValueError):
    """A request that the store does not take."""


class NotFound(LookupError):
    """An id or state that does not exist."""


class Store:
    """Tools over the tables in ``folder``. ``now`` gives the present in milliseconds, ``embedder`` vectors; without one only keywords are searched.

    Keyword searches read indexes kept beside the tables; they follow the tables when a search next needs them.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, now=None):
        import time

        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder
        self.now = now or (lambda: int(time.time() * 1000))
        self.jobs: dict[str, dict] = {}

    # ------------------------------------------------------------ tables

    def _names(self, path: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(target):
            return []
        names = [x.getPath().getName() for x in system.listStatus(target)]
        return sorted(int(n) for n in names if n.isdigit() and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) or n.isdigit() and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/0/_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        generations = self._names(path)
        if not generations:
            return self.spark.createDataFrame([], SCHEMAS[name])
        parts = self._names(f"{path}/{generations[-1]}")
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{path}/{generations[-1]}/{p}" for p in parts])

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])

    def append(self, name: str, rows: DataFrame) -> None:
        path = f"{self.folder}/{name}"
        generation = (self._names(path) or [0])[-1]
        part = (self._names(f"{path}/{generation}") or [-1])[-1] + 1
        self._written(name, rows, f"{path}/{generation}/{part}")

    def replace(self, name: str, rows: DataFrame) -> None:
        path = f"{self.folder}/{name}"
        generation = (self._names(path) or [-1])[-1] + 1
        self._written(name, rows, f"{path}/{generation}/0")

    def _written(self, name: str, rows: DataFrame, path: str) -> None:
        """Sorted by id within files, with a Bloom filter of the ids, so that a lookup opens only row groups that can hold its id."""
        shaped = self._shaped(name, rows)
        writer = shaped.sortWithinPartitions("id").write if "id" in shaped.columns else shaped.write
        writer.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").parquet(path)

    def _rows(self, values: list[dict], schema: str) -> DataFrame:
        names = [f.split()[0] for f in schema.split(", ")]
        return self.spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], schema)

    def _embedded(self, rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumn("embedding", self.embedder.column(text)) if self.embedder else rows

    # ------------------------------------------------------------ records

    def store_memory(self, content: str, tier: str = "episodic", **fields) -> str:
        """One record; too large, secret or injected content is refused."""
        if tier not in ("episodic", "semantic", "procedural"):
            raise InvalidInput(f"tier {tier!r}")
        if len((content or "").encode()) > C.MOST_BYTES or not content:
            raise InvalidInput("content is missing or over 64 KB")
        row = self.spark.range(1).select(tables.secret_kind(F.lit(content)).alias("secret"), tables.injection_score(F.lit(content)).alias("score")).first()
        if row.secret or row.score >= C.BLOCKED:
            raise InvalidInput(row.secret or "injection")
        own = ids.uuid7(self.now())
        schema = "id string, tier string, content string, source_type string, source_id string, source_author string, tags array<string>, created_at long, entity_ids array<string>"
        self._store(self._rows([{"id": own, "tier": tier, "content": content, "created_at": self.now()} | fields], schema))
        return own

    def _store(self, rows: DataFrame) -> None:
        whole = rows.withColumns({"importance": F.lit(0.5), "access_count": F.lit(0), "last_accessed": F.col("created_at"), "consolidated": F.lit(False)})
        whole = self._embedded(whole, "content")
        self.append("memories", whole)
        if self.embedder:
            self.append("chunks", self._passages(rows))

    def _passages(self, rows: DataFrame) -> DataFrame:
        def run(parts):
            import pandas as pd

            for part in parts:
                found = [(f"{i}#{k}", i, k, low, n, text[low : low + n]) for i, text in zip(part["id"], part["content"]) for k, (low, n) in enumerate(turn_chunks(text))]
                yield pd.DataFrame(found, columns=["id", "parent_id", "sequence", "char_offset", "char_length", "text"])

        cut = rows.select("id", "content").mapInPandas(run, "id string, parent_id string, sequence int, char_offset int, char_length int, text string")
        return self._embedded(cut, "text").drop("text")

    def retrieve_memory(self, own: str):
        """The record, with this access counted on what is returned."""
        row = self.table("memories").where(F.col("id") == own).first()
        if row is None:
            raise NotFound(own)
        return row.asDict() | {"access_count": row.access_count + 1, "last_accessed": self.now()}

    def update_memory(self, own: str, **fields) -> None:
        """Fields of a record, in place; passages follow new content."""
        self.retrieve_memory(own)
        hit = F.col("id") == own
        changed = self.table("memories").withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items()})
        if "content" in fields and self.embedder:
            fresh = self.embedder.column("content")
            changed = changed.withColumn("embedding", F.when(hit, fresh).otherwise(F.col("embedding")))
        self.replace("memories", changed)
        if "content" in fields and self.embedder:
            rest = self.table("chunks").where(F.col("parent_id") != own)
            self.replace("chunks", rest.unionByName(self._shaped("chunks", self._passages(self.table("memories").where(hit)))))

    def delete_memory(self, own: str) -> None:
        """The record and its passages; edges at it stay until indexes are rebuilt."""
        self.retrieve_memory(own)
        self.replace("memories", self.table("memories").where(F.col("id") != own))
        self.replace("chunks", self.table("chunks").where(F.col("parent_id") != own))

    def list_memories(self, source_type: str | None = None, tier: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        own = self.table("memories").select("id", "tier", "source_type", "created_at", F.substring("content", 1, 200).alias("preview"))
        return tables.listed(own, source_type, tier, offset, limit)

    # ------------------------------------------------------------ searches

    def _vectors(self) -> DataFrame:
        return self.table("memories").select("id", "embedding").unionByName(self.table("chunks").select("id", "embedding"))

    def _index(self, again: bool = False) -> index.KeywordIndex:
        """Records (kind 0) and entities (kind 1) with all their searched columns, as they are now.

        What was appended to a table since the index was last searched is appended to the index; a table that was rewritten is compared with it, and
        only documents that changed are written or removed. With ``again`` both tables are compared whole.
        """
        searched = {"memories": (0, "tags", ["content", "source_type", "source_author", "_list"]), "entities": (1, "observations", ["name", "entity_type", "_list"])}
        kept = index.KeywordIndex(self.spark, f"{self.folder}/index", "string")
        covered = json.loads(kept.covers or "{}")
        for name, (kind, listed, columns) in searched.items():
            generation = (self._names(f"{self.folder}/{name}") or [0])[-1]
            parts = self._names(f"{self.folder}/{name}/{generation}")
            had, many = covered.get(name, [0, 0])
            if [generation, len(parts)] == [had, many] and not again or not parts:
                continue
            appended = had == generation and 0 < many and not again
            rows = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/{name}/{generation}/{p}" for p in parts[many if appended else 0 :]])
            own = rows.withColumn("_list", F.array_join(F.coalesce(listed, F.array().cast("array<string>")), " ", ""))
            docs = keyword.tokenised(own, columns, stemmed=True).select("id", F.lit(kind).alias("kind"), "tokens")
            covered[name] = [generation, len(parts)]
            if appended:
                kept.append(docs, covers=json.dumps(covered))
            else:
                kept.sync(docs, kind, json.dumps(covered))
        return kept

    def search_keyword(self, query: str, k: int = C.TOP_K) -> DataFrame:
        """(id, content, tier, score); entities take places and are then shown without content."""
        best = keyword.top(self._index().search(query, stemmed=True), keyword.clamp_k(k)).where("kind = 0")
        found = best.join(self.table("memories").select("id", "content", "tier"), "id", "left")
        return found.select("id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("tier", F.lit("unknown")).alias("tier"), "score").orderBy(F.desc("score"), "id")

    def search_semantic(self, query: str, k: int = C.TOP_K) -> DataFrame:
        if not self.embedder:
            raise InvalidInput("no embedder")
        found = vector.semantic(self._vectors(), self.table("chunks"), self.table("memories"), self.embedder.vector(query), keyword.clamp_k(k))
        return found.orderBy(F.desc("score"), "id")

    def _rankers(self, query: str) -> dict[str, DataFrame]:
        parts = {"keyword": hybrid.keyword_ranks(self._index().search(query, stemmed=True))}
        if self.embedder:
            asked = self.embedder.vector(query)
            parts["vector"] = hybrid.vector_ranker(self._vectors(), self.table("chunks"), asked)
            parts["graph"] = hybrid.graph_ranker(self.table("entities"), self.table("edges"), asked)
        return parts

    def search_hybrid(self, query: str, k: int = C.TOP_K, tier: str | None = None, since: int = 0, until: int = 0) -> DataFrame:
        """Keyword, vector and graph ranks fused; optional filters are laid on the records."""
        parts = self._rankers(query)
        known = self.table("memories").where(temporal.within("created_at", since, until))
        known = known.where(F.col("tier") == tier) if tier else known
        return hybrid.results(hybrid.fuse(parts), known.select("id", "content", "tier"), keyword.clamp_k(k))

    def search_temporal(self, since: str = "", until: str = "", k: int = C.TOP_K) -> DataFrame:
        low, high = self._ms(since), temporal.until_ms(self._ms(until), len(until) == 10)
        return temporal.search_created(self.table("memories").select("id", "content", "tier", "created_at"), low, high, keyword.clamp_k(k))

    def search_entities(self, query: str, entity_type: str | None = None, k: int = C.TOP_K) -> DataFrame:
        k = keyword.clamp_k(k)
        # scores count records too, places only entities
        hits = self._index().search(query, stemmed=True).where("kind = 1").orderBy(F.desc("score"), "id").limit(2 * k)
        found = hits.join(self.table("entities"), "id").select("id", "name", "entity_type", "score", F.size("observations").alias("observation_count"))
        return (found.where(F.col("entity_type") == entity_type) if entity_type else found).orderBy(F.desc("score"), "id").limit(k)

    def search_truncated(self, query: str, k: int = C.TOP_K) -> bool:
        """Whether a hybrid search finds more ids than it gives; a keyword search is never told as cut."""
        parts = self._rankers(query)
        return hybrid.truncated(hybrid.fuse(parts), keyword.clamp_k(k)).first().truncated

    def _ms(self, text: str) -> int:
        return self.spark.range(1).select(dates.iso_ms(F.lit(text or ""))).first()[0]

    # ------------------------------------------------------------ entities and edges

    def create_entity(self, name: str, entity_type: str, observations: list[str] | None = None, event_date: int = 0) -> str:
        if not name or not entity_type:
            raise InvalidInput("name and type are needed")
        own, now = ids.uuid7(self.now()), self.now()
        schema = "id string, name string, entity_type string, observations array<string>, created_at long, updated_at long, event_date long, importance double, access_count long, last_accessed long"
        row = {"id": own, "name": name, "entity_type": entity_type, "observations": observations or [], "created_at": now, "updated_at": now, "event_date": event_date, "importance": 0.5, "access_count": 0, "last_accessed": 0}
        rows = self._rows([row], schema)
        self.append("entities", self._embedded(rows, "name"))
        self._version(rows)
        return own

    def _version(self, rows: DataFrame) -> None:
        fresh = rows.select("id", F.col("updated_at").alias("valid_from"), "updated_at", F.to_json(F.struct("name", "entity_type", "observations")).alias("value"))
        old = self.table("versions").join(fresh.select("id"), "id", "left_semi")
        places = temporal.bumped(old.withColumn("seq", F.lit(0)).unionByName(fresh.withColumn("seq", F.lit(1)))).where("seq = 1").drop("seq")
        self.append("versions", places)

    def get_entity(self, own: str):
        row = self.table("entities").where(F.col("id") == own).first()
        if row is None:
            raise NotFound(own)
        return row.asDict()

    def add_observation(self, own: str, observation: str) -> None:
        """Appended, repeats allowed; the vector stays that of the name."""
        hit = F.col("id") == own
        if self.table("entities").where(hit).isEmpty():
            raise NotFound(own)
        grown = F.when(hit, F.concat("observations", F.array(F.lit(observation)))).otherwise(F.col("observations"))
        self.replace("entities", self.table("entities").withColumns({"observations": grown, "updated_at": F.when(hit, F.lit(self.now())).otherwise(F.col("updated_at"))}))
        self._version(self.table("entities").where(hit))

    def create_relation(self, source: str, target: str, edge_type: str, description: str = "") -> str:
        own, now = ids.uuid7(self.now()), self.now()
        self._edges(self._rows([{"id": own, "source_id": source, "target_id": target, "edge_type": edge_type, "description": description}], "id string, source_id string, target_id string, edge_type string, description string"), now)
        return own

    def _edges(self, rows: DataFrame, now: int) -> None:
        made = {"weight": F.lit(1.0), "valid_from": F.lit(now), "created_at": F.lit(now), "valid_to": F.lit(0), "expired_at": F.lit(0)}
        self.append("edges", rows.withColumns({k: v for k, v in made.items() if k not in rows.columns}))

    def delete_entity(self, own: str) -> None:
        """The entity and all edges at it; its versions stay."""
        gone = self._rows([{"id": own}], "id string")
        entities, edges = graph.delete_entities(self.table("entities"), self.table("edges"), gone)
        self.replace("entities", entities)
        self.replace("edges", edges)

    def link_entities(self) -> int:
        new = graph.link_mentions(self.table("entities"), self.table("memories"), self.table("edges"))
        before = self.table("edges").count()
        self._edges(new.withColumn("id", F.concat_ws("-", F.lit("link"), "source_id", "target_id")), self.now())
        return self.table("edges").count() - before

    def resolve_entities(self) -> int:
        """Merge entities of one name and type; their edges move to the one that stays. Returns how many went."""
        entities, edges = self.table("entities"), self.table("edges")
        mapping = graph.resolution(entities)
        moved = graph.repointed(edges, mapping.where("id <> canonical_id"))
        first = edges.groupBy(*graph.EDGE).agg(*[F.first(c).alias(c) for c in edges.columns if c not in graph.EDGE])
        merged, before = graph.resolved(entities), entities.count()
        self.replace("edges", moved.join(first, graph.EDGE, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))))
        self.replace("entities", merged)
        return before - self.table("entities").count()

    def get_entity_graph(self, own: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        return graph.neighbourhood(self.table("entities"), self.table("edges"), own, depth)

    # ------------------------------------------------------------ time

    def _current(self) -> DataFrame:
        return self.table("entities").select("id", "created_at", "updated_at", F.to_json(F.struct("name", "entity_type", "observations")).alias("value"))

    def get_history(self, own: str, since: str = "", until: str = "") -> DataFrame:
        return temporal.history(self.table("versions"), self._current(), own, self._ms(since), self._ms(until))

    def get_state_at_time(self, own: str, at: str):
        hit = F.col("id") == own
        row = temporal.state_at(self.table("versions").where(hit).select("id", "valid_from", "value"), self._current().where(hit), self._ms(at)).first()
        if row is None:
            raise NotFound(own)
        return row

    def get_changes_since(self, since: str, entity_type: str | None = None, k: int = 50) -> DataFrame:
        return temporal.changes_since(self.table("entities"), self._ms(since), min(k if k > 0 else 50, 50), entity_type)

    def backfill_versions(self) -> None:
        whole = temporal.backfilled(self.table("versions").select("id", "valid_from", "value"), self._current())
        self.replace("versions", whole.withColumn("updated_at", F.col("valid_from")))

    def extract_events(self, text: str, memory_id: str | None = None, context_year: int = 0) -> list[str]:
        """An event entity for each date in a text, named by the beginning of its sentence, linked to its record."""
        year, out = context_year or int(self.spark.range(1).select(F.year(F.timestamp_millis(F.lit(self.now())))).first()[0]), []
        for said, ms in dates.extract_events(text, year):
            name = said[:60]
            name = name[: name.rfind(" ")] if len(said) > 60 and name.rfind(" ") > 30 else name
            out.append(self.create_entity(name, "event", [said], ms))
            if memory_id:
                self.create_relation(out[-1], memory_id, "extracted_from")
        return out

    def search_events(self, since: str = "", until: str = "", name: str | None = None, k: int = 20) -> DataFrame:
        high = temporal.until_ms(self._ms(until), len(until) == 10)
        found = temporal.search_events(self.table("entities"), self._ms(since), high, min(k if k > 0 else 20, C.MOST_K), name)
        return found.select("id", "event_date", temporal.event_content("name", dates.shown_iso("event_date"), "observations").alias("content"))

    def calculate_duration(self, start: str, end: str):
        both = self.spark.createDataFrame([(self._ms(start), self._ms(end))], "a long, b long").select(*temporal.duration("a", "b"))
        return both.first()

    # ------------------------------------------------------------ lifecycle

    def consolidate_memories(self, topic: str | None = None, dry_run: bool = False) -> dict:
        memories, found = self.table("memories"), lifecycle.candidates(self.table("memories"), topic)
        n = found.count()
        if dry_run:
            return {"candidates": n, "dry_run": True}
        referenced = found.select(F.explode("entity_ids").alias("id"))
        mapping = lifecycle.merged_entities(self.table("entities"), referenced).where("id <> canonical_id")
        merged = mapping.count()
        if merged:
            entities = self.table("entities")
            more = entities.join(mapping, "id").groupBy(F.col("canonical_id").alias("id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "observations"))), lambda x: x["observations"])).alias("more"))
            kept = entities.join(mapping.select("id"), "id", "left_anti").join(more, "id", "left")
            self.replace("entities", kept.withColumn("observations", F.concat("observations", F.coalesce("more", F.array().cast("array<string>")))))
        self.replace("memories", lifecycle.consolidated(memories, topic))
        return {"candidates": n, "merged_entities": merged, "dry_run": False}

    def prune_stale(self, min_age_days: int = C.PRUNE_AGE_DAYS, min_importance: float = C.PRUNE_BELOW, dry_run: bool = True) -> list[str]:
        """Ids of the first 200 stale records, which are deleted unless this is a dry run."""
        found = [r.id for r in lifecycle.stale(self.table("memories"), self.now(), min_age_days, min_importance).select("id").collect()]
        if found and not dry_run:
            self.replace("memories", self.table("memories").where(~F.col("id").isin(found)))
            self.replace("chunks", self.table("chunks").where(~F.col("parent_id").isin(found)))
        return found

    def rebuild_indexes(self, target: str = "all") -> dict:
        """Vectors, passages and terms from the truth; edges without both ends go."""
        if target not in ("fts", "vector", "all"):
            raise InvalidInput(target)
        out = {}
        if target != "fts" and self.embedder:
            self.replace("memories", self._embedded(self.table("memories"), "content"))
            self.replace("entities", self._embedded(self.table("entities"), "name"))
            self.replace("chunks", self._passages(self.table("memories")))
            out["vectors"] = self._vectors().where("embedding is not null").count()
        if target != "vector":
            out["terms"] = self._index(again=True).all_postings().count()
        known = self.table("entities").select("id").union(self.table("memories").select("id"))
        before = self.table("edges").count()
        self.replace("edges", graph.without_orphans(self.table("edges"), known))
        return out | {"orphan_edges": before - self.table("edges").count()}

    # ------------------------------------------------------------ import

    def import_batch(self, items: list[dict]) -> dict:
        schema = "place long, content string, source_type string, tier string, tags array<string>, created_at long"
        rows = self._rows([{"place": k, "tier": "episodic"} | x for k, x in enumerate(items)], schema)
        return self._import(files.batch_records(rows))

    def _import(self, records: DataFrame) -> dict:
        good = records.where("status = 'imported'")
        made = F.when(F.coalesce("created_at", F.lit(0)) > 0, F.col("created_at")).otherwise(F.lit(self.now()))
        rows = good.withColumns({"id": F.expr("uuid()"), "created_at": made, "tier": F.col("tier") if "tier" in good.columns else F.lit("episodic")})
        total = files.counters(records).first().asDict()
        if total["imported"]:
            self._store(checkpointed(rows))  # ids are drawn once
        return total

    def import_file(self, path: str, roots: list[str], kind: str | None = None, preserve_timestamps: bool = True, strategy: str = "paragraph") -> dict:
        if not files.path_allowed(path, roots):
            raise InvalidInput(path)
        kind = kind or self.spark.range(1).select(files.file_format(F.lit(path))).first()[0]
        own = self.spark.read.text(path) if kind == "jsonl" else files.read_files(self.spark, path)
        readers = {"jsonl": lambda: files.jsonl_records(own, preserve=preserve_timestamps), "csv": lambda: files.csv_records(own), "mbox": lambda: files.mbox_records(own, preserve=preserve_timestamps)}
        return self._import(readers.get(kind, lambda: files.text_records(own, strategy=strategy))())

    def import_directory(self, folder: str, roots: list[str], pattern: str = "*", recursive: bool = False) -> str:
        """The files of a folder, each by its format; returns a job id for ``get_import_status``."""
        if not files.path_allowed(folder, roots):
            raise InvalidInput(folder)
        own = files.read_files(self.spark, folder, pattern, recursive).withColumn("kind", files.file_format("path"))
        lines = own.where("kind = 'jsonl'").select(F.explode(F.split("text", "\n")).alias("value"))
        parts = [files.jsonl_records(lines), files.unread(own.where("kind = 'jsonl'")), files.csv_records(own.where("kind = 'csv'")), files.mbox_records(own.where("kind = 'mbox'")), files.text_records(own.where("kind in ('text', 'markdown')"))]
        job = ids.uuid7(self.now())
        self.jobs[job] = {"status": "running"}
        self.jobs[job] = {"status": "complete"} | self._import(reduce(DataFrame.unionByName, parts))
        return job

    def get_import_status(self, job: str) -> dict:
        if job not in self.jobs:
            raise NotFound(job)
        return self.jobs[job]

    # ------------------------------------------------------------ the store itself

    def get_memory_stats(self) -> dict:
        return {r.table_name: r.n for r in tables.counts({n: self.table(n) for n in ("memories", "entities", "edges")}).collect()}

    def get_index_stats(self) -> dict:
        return {"vectors": self._vectors().where("embedding is not null").count(), "documents": self._index().stats()[0]}

    def audit(self, events: list[dict], kind: str = "audit") -> None:
        """Append events (or, as kind ``alert``, alerts) to the store's JSON lines, each with its time."""
        if kind not in ("audit", "alert"):
            raise InvalidInput(kind)
        rows = [(self.now(), str(e.get("tool", "")), str(e.get("outcome", "")), str(e.get("detail", ""))) for e in events]
        self.spark.createDataFrame(rows, "at long, tool string, outcome string, detail string").coalesce(1).write.mode("append").json(f"{self.folder}/log/{kind}")

    def health_check(self) -> dict:
        return {"status": "ok", "embedding": self.embedder is not None}

    def get_hardware_info(self) -> dict:
        return {"machine": platform.machine(), "cores": self.spark.sparkContext.defaultParallelism}

    def call(self, tool: str, **arguments):
        """A tool by name; decoys and unknown names are refused."""
        if tool in DECOYS:
            raise PermissionError(tool)
        if tool not in TOOLS:
            raise InvalidInput(tool)
        return getattr(self, tool)(**arguments)


# The names that ``Store.call`` takes.
TOOLS = tuple(
    "store_memory retrieve_memory update_memory delete_memory delete_entity search_hybrid search_semantic search_keyword search_temporal create_entity add_observation create_relation get_memory_stats health_check link_entities resolve_entities search_entities import_batch import_file import_directory get_import_status rebuild_indexes get_history get_state_at_time get_changes_since prune_stale get_hardware_info get_index_stats extract_events search_events calculate_duration consolidate_memories list_memories get_entity_graph".split()
)
