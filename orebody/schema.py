"""The 41 index tables. Types: S string, L long, I int, D double, B boolean, X binary; ``?`` marks nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2

_KINDS = {"S": T.StringType(), "L": T.LongType(), "I": T.IntegerType(), "D": T.DoubleType(), "B": T.BooleanType(), "X": T.BinaryType()}

_CHANGE = "change_type:S path:S old_path:S? similarity:I? added_lines:I? removed_lines:I? src_blob_sha:S dst_blob_sha:S src_mode:S dst_mode:S"

# Table and column names of the index format.
_TABLES = {
    "commits": "commit_sha:S author_id:S authored_at_epoch:L authored_at_offset_minutes:I committer_id:S committed_at_epoch:L committed_at_offset_minutes:I subject:S? parent_count:I is_merge:B is_root:B",
    "commit_parents": "commit_sha:S parent_index:I parent_sha:S",
    "commit_messages": "commit_sha:S body:S? encoding:S? is_signed:B",
    "commit_trailers": "commit_sha:S seq:I key:S value:S",
    "authors": "author_id:S name:S email:S identity_id:L",
    "identities": "identity_id:L name:S email:S confidence:D alias_count:I",
    "identity_aliases": "identity_id:L author_id:S name:S email:S method:S confidence:D",
    "identity_reviews": "identity_a:L identity_b:L name_a:S name_b:S reason:S similarity:D",
    "files": "file_id:L path:S",
    "commit_files": "commit_sha:S file_id:L old_path_id:L? change_type:S similarity:I? added_lines:I? removed_lines:I? src_blob_sha:S dst_blob_sha:S src_mode:S dst_mode:S",
    "merge_changes": f"commit_sha:S {_CHANGE}",
    "commit_stats": "commit_sha:S files_changed:I insertions:L deletions:L net_lines:L",
    "commit_classes": "commit_sha:S kind:S scope:S is_conventional:B is_breaking:B",
    "hunks": "commit_sha:S file_id:L seq:I old_start:I old_lines:I new_start:I new_lines:I",
    "blame": "file_id:L line_number:I commit_sha:S",
    "blame_snapshots": "snapshot_ref:S snapshot_sha:S path:S line_number:I commit_sha:S",
    "snapshot_ownership": "snapshot_ref:S snapshot_sha:S identity_id:L owned_lines:L total_lines:L ownership_share:D",
    "file_ownership": "file_id:L identity_id:L owned_lines:L file_lines:L ownership_share:D",
    "area_ownership": "area:S identity_id:L owned_lines:L area_lines:L ownership_share:D",
    "coupling": "file_a_id:L file_b_id:L co_changes:L",
    "collaboration": "identity_a:L identity_b:L shared_files:L a_files:L b_files:L strength:D",
    "insights": "kind:S severity:S subject:S metric:D detail:S",
    "symbols": "file_id:L blob_sha:S name:S kind:S start_line:I end_line:I lang:S",
    "symbol_refs": "file_id:L blob_sha:S name:S ref_kind:S line:I lang:S def_file_id:L?",
    "module_deps": "from_file_id:L to_file_id:L ref_count:L",
    "symbol_edges": "src_file_id:L src_name:S src_kind:S src_start_line:I dst_name:S dst_file_id:L? dst_start_line:I? ref_kind:S line:I lang:S",
    "chunks": "chunk_hash:S bytes:X size:I ref_count:I",
    "blob_chunks": "blob_sha:S seq:I offset:L size:I chunk_hash:S",
    "commit_trees": "commit_sha:S root_tree_sha:S",
    "tree_objects": "tree_sha:S seq:I name:S mode:S entry_type:S entry_sha:S",
    "tree_entries": "file_id:L path:S mode:S entry_type:S blob_sha:S size:L?",
    "test_files": "file_id:L lang:S signal:S",
    "test_coverage": "test_file_id:L source_file_id:L method:S",
    "generated_files": "file_id:L category:S reason:S",
    "blob_facts": "blob_sha:S size_bytes:L line_count:L is_binary:B",
    "secret_findings": "file_id:L line:I rule:S preview:S",
    "code_markers": "file_id:L line:I marker:S text:S",
    "dependencies": "manifest_path:S ecosystem:S name:S version:S scope:S",
    "submodules": "path:S name:S? url:S? branch:S? pinned_sha:S? in_gitmodules:B in_tree:B",
    "refs": "name:S kind:S object_sha:S peeled_commit_sha:S? is_symbolic:B tagger_name:S? tagger_email:S? tagged_at_epoch:L? tag_subject:S? tag_body:S?",
    "notes": "notes_ref:S target_sha:S note_sha:S body:S",
}


def _field(spec: str) -> T.StructField:
    name, kind = spec.split(":")
    return T.StructField(name, _KINDS[kind[0]], kind.endswith("?"))


SCHEMAS = {name: T.StructType([_field(f) for f in spec.split()]) for name, spec in _TABLES.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the table's columns and types, by name."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
