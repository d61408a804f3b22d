"""The graph: a bundle of lazy tables with fixed schemas. Nothing is read until a query runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Store

#: Portable schemas of the graph's tables, by name (Spark DDL).
SCHEMAS = {
    "entities": "id STRING, name STRING, domain STRING, type STRING, user_tag STRING, deprecated BOOLEAN, created_at TIMESTAMP_NTZ, owner_id STRING, org_id STRING, visibility STRING, acl_json STRING, share_group_id STRING, embedding ARRAY<FLOAT>",
    "events": "id STRING, domain STRING, summary STRING, vector_id STRING, timestamp STRING, order_index BIGINT, deprecated BOOLEAN, influence_score DOUBLE, created_at TIMESTAMP_NTZ, owner_id STRING, org_id STRING, visibility STRING, acl_json STRING, share_group_id STRING, source_provider STRING, source_id STRING, source_version STRING, embedding ARRAY<FLOAT>",
    "groups": "id STRING, name STRING, level INT, domain STRING, parent_id STRING, source STRING, type STRING, summary STRING, deprecated BOOLEAN, created_at TIMESTAMP_NTZ, visibility STRING, owner_id STRING, org_id STRING, share_group_id STRING",
    "participated_in": "entity_id STRING, event_id STRING, created_at TIMESTAMP_NTZ",
    "event_member_of": "event_id STRING, group_id STRING, kind STRING",
    "event_sequential_next": "prev_id STRING, next_id STRING, source STRING",
    "entity_connection": "a_id STRING, b_id STRING, event_count BIGINT",
    "event_jaccard_connected": "a_id STRING, b_id STRING, entity_jaccard DOUBLE, group_jaccard DOUBLE, entity_intersection BIGINT, group_intersection BIGINT",
    "content_store": "content_id STRING, domain STRING, vector_id STRING, content_type STRING, storage_uri STRING, inline_meta STRING, created_at TIMESTAMP_NTZ",
    "train_run": "id STRING, kind STRING, domain STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, status STRING, params_json STRING, metrics_json STRING, rows_written BIGINT, error_text STRING, triggered_by STRING",
    "community_assignment": "run_id STRING, node_kind STRING, node_id STRING, community_id BIGINT",
    "build_file_manifest": "id BIGINT, domain STRING, file_path STRING, file_hash STRING, segment_count INT, build_id STRING, built_at STRING, source_root STRING, status STRING, stage_state STRING",
    "build_segment_manifest": "id BIGINT, domain STRING, file_path STRING, segment_key STRING, segment_index INT, segment_hash STRING, vector_id STRING, old_vector_id STRING, event_id STRING, build_id STRING, built_at STRING, status STRING, stage_state STRING",
    "context_groups": "id STRING, name STRING, domain STRING, stage STRING, parent_id STRING, order_index BIGINT, created_at TIMESTAMP_NTZ, cluster_source STRING, plan_id STRING, plan_stage STRING, expected_entities STRING, abandon_reason STRING, template_id STRING, transition_pattern STRING, source_cg_ids STRING, instance_count BIGINT",
    "event_template_groups": "id STRING, name STRING, domain STRING, transition_pattern STRING, structure_description STRING, entity_list STRING, confidence DOUBLE, instance_count BIGINT, created_at TIMESTAMP_NTZ",
    "plan_nodes": "id STRING, plan_id STRING, etg_id STRING, domain STRING, name STRING, stage STRING, objective_summary STRING, structure_description STRING, entity_ids STRING, entity_summary STRING, order_index BIGINT, realized_event_id STRING, parent_id STRING, abandon_reason STRING, created_at TIMESTAMP_NTZ",
    "plan_direction_nodes": "id STRING, plan_id STRING, domain STRING, goal_text STRING, stage STRING, entity_ids STRING, entity_summary STRING, order_index BIGINT, realized_event_id STRING, abandon_reason STRING, created_at TIMESTAMP_NTZ",
    "context_edges": "source_id STRING, source_kind STRING, target_id STRING, target_kind STRING, rel STRING, order_index BIGINT",
    "entity_alias": "entity_id_a STRING, entity_id_b STRING, relation STRING, confidence DOUBLE, asserted_by STRING, asserted_at TIMESTAMP_NTZ",
}

#: Primary keys, for merges and upserts.
KEYS = {
    "entities": ["id"], "events": ["id"], "groups": ["id"], "participated_in": ["entity_id", "event_id"], "event_member_of": ["event_id", "group_id"],
    "event_sequential_next": ["prev_id", "next_id", "source"], "entity_connection": ["a_id", "b_id"], "event_jaccard_connected": ["a_id", "b_id"],
    "content_store": ["content_id"], "train_run": ["id"], "community_assignment": ["run_id", "node_kind", "node_id"], "build_file_manifest": ["id"],
    "build_segment_manifest": ["id"], "context_groups": ["id"], "event_template_groups": ["id"], "plan_nodes": ["id"], "plan_direction_nodes": ["id"], "context_edges": ["source_id", "target_id", "rel"], "entity_alias": ["entity_id_a", "entity_id_b", "relation"],
}


class Tables(dict):
    """Tables by name. One that is given as a function is made when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        table = super().__getitem__(name)
        if callable(table):
            self[name] = table = table()
        return table

    def items(self):
        return [(n, self[n]) for n in self]

    def values(self):
        return [self[n] for n in self]


@dataclass(frozen=True)
class EventGraph:
    """Tables by name. Ids may be strings or integers; a graph uses one kind throughout."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in SCHEMAS:
            raise AttributeError(name)
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SCHEMAS[name])

    def with_tables(self, **tables: DataFrame | Callable[[], DataFrame]) -> EventGraph:
        new = Tables(dict.items(self.tables))
        new.update(tables)
        return replace(self, tables=new)

    @classmethod
    def read(cls, spark: SparkSession, root: str, names: list[str] | None = None) -> EventGraph:
        """A graph saved by ``write``."""
        return cls(spark, {n: spark.read.parquet(f"{root}/{n}") for n in names or SCHEMAS})

    def write(self, root: str, mode: str = "overwrite") -> None:
        """Node tables are partitioned by domain, so a query of one domain reads only its files."""
        for name, df in self.tables.items():
            by = ["domain"] if name in ("entities", "events", "groups") else []
            df.write.mode(mode).partitionBy(*by).parquet(f"{root}/{name}")

    @classmethod
    def committed(cls, store: Store, version: int | None = None) -> EventGraph:
        """The graph of a store's newest version, or of an older one."""
        at = store.snapshot(version)
        return cls(store.spark, {n: at.table(n) for n in at.names()})

    def commit(self, store: Store, note: str = "") -> int:
        """All tables as the store's next version: readers see all of them or none. Returns the version."""
        return store.commit(self.tables, note=note).version

    def live(self, name: str) -> DataFrame:
        return getattr(self, name).where(~F.coalesce(F.col("deprecated"), F.lit(False)))
