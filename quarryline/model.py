"""Row types of the engine."""

from __future__ import annotations

FILE = "codebase_id string, relative_path string, content string"
CHUNK = "relative_path string, ordinal int, content string, start_line int, end_line int, language string"
STORED = (
    "collection string, id string, chunk_hash string, content string, relative_path string, "
    "start_line int, end_line int, language string, vector array<float>"
)
MANIFEST = "codebase_id string, relative_path string, sha256 string, size bigint, mtime_ns bigint"
MANIFEST_JSON = "version int, files map<string,struct<sha256:string,size:bigint,mtime_ns:bigint>>, last_sync string"
REGISTRY = "collection string, codebase_id string"
REGISTRY_META = "map<string,struct<codebase_id:string,languages:map<string,bigint>>>"
REGISTRY_LEGACY = "map<string,string>"
POSTING = "collection string, chunk_id string, token string, tf bigint"
CHANGE = "seq bigint, op string, codebase_id string, relative_path string, content string"
SCAN = "abs_path string, relative_path string, size bigint, mtime_ns bigint, content binary"
