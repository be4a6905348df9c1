"""The catalog: small driver-side metadata in SQLite, each table readable as a DataFrame."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "entity_readiness": "entity_uri TEXT PRIMARY KEY, entity_type TEXT, last_synced_at INTEGER, ttl_seconds INTEGER, coverage_metrics TEXT",
    "api_budget": "api_endpoint TEXT PRIMARY KEY, requests_left INTEGER, reset_time INTEGER",
    "task_logs": "task_id TEXT PRIMARY KEY, task_name TEXT, start_time INTEGER, end_time INTEGER, status TEXT, details TEXT",
    "ingestion_offsets": "table_path TEXT PRIMARY KEY, entity_type TEXT, category TEXT, primary_keys TEXT, last_version INTEGER NOT NULL DEFAULT -1",
    "source_anchors": "entity_uri TEXT, fetcher TEXT, anchor_key TEXT, anchor_value TEXT, updated_at INTEGER, PRIMARY KEY (entity_uri, fetcher, anchor_key)",
}
SPARK_TYPES = {"TEXT": "string", "INTEGER": "bigint"}


class Catalog:
    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.db.row_factory = sqlite3.Row
        self.lock = threading.Lock()
        with self.lock, self.db:
            for name, columns in TABLES.items():
                self.db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")

    def _put(self, table: str, keys: list[str], row: dict, keep: tuple[str, ...] = ()) -> None:
        names = list(row)
        changed = [c for c in names if c not in keys and c not in keep]
        action = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in changed) if changed else "NOTHING"
        sql = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))}) ON CONFLICT ({', '.join(keys)}) DO {action}"
        with self.lock, self.db:
            self.db.execute(sql, list(row.values()))

    def _get(self, table: str, **keys: object) -> dict | None:
        where = " AND ".join(f"{k} = ?" for k in keys)
        with self.lock:
            row = self.db.execute(f"SELECT * FROM {table} WHERE {where}", list(keys.values())).fetchone()
        return dict(row) if row else None

    def rows(self, table: str) -> list[dict]:
        with self.lock:
            return [dict(r) for r in self.db.execute(f"SELECT * FROM {table} ORDER BY 1")]

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        parts = [c.split()[:2] for c in TABLES[table].split(", PRIMARY KEY (")[0].split(", ")]
        schema = ", ".join(f"{name} {SPARK_TYPES[kind]}" for name, kind in parts)
        return spark.createDataFrame([tuple(r[name] for name, _ in parts) for r in self.rows(table)], schema)

    # readiness, budget, anchors

    def set_readiness(self, uri: str, entity_type: str, ttl: int | None = 3600, coverage: dict | None = None, now: int | None = None) -> None:
        self._put(
            "entity_readiness", ["entity_uri"],
            {
                "entity_uri": uri, "entity_type": entity_type, "last_synced_at": int(time.time()) if now is None else now, "ttl_seconds": ttl,
                "coverage_metrics": json.dumps(coverage or {}),
            },
        )

    def readiness(self, uri: str) -> dict | None:
        return self._get("entity_readiness", entity_uri=uri)

    def set_budget(self, endpoint: str, left: int, reset: int) -> None:
        self._put("api_budget", ["api_endpoint"], {"api_endpoint": endpoint, "requests_left": left, "reset_time": reset})

    def budget(self, endpoint: str) -> dict | None:
        return self._get("api_budget", api_endpoint=endpoint)

    def set_anchor(self, uri: str, fetcher: str, key: str, value: str, now: int | None = None) -> None:
        self._put(
            "source_anchors", ["entity_uri", "fetcher", "anchor_key"],
            {"entity_uri": uri, "fetcher": fetcher, "anchor_key": key, "anchor_value": value, "updated_at": int(time.time()) if now is None else now},
        )

    def anchor(self, uri: str, fetcher: str, key: str) -> str | None:
        row = self._get("source_anchors", entity_uri=uri, fetcher=fetcher, anchor_key=key)
        return row and row["anchor_value"]

    # tasks

    def start_task(self, name: str, details: str = "") -> str:
        task = uuid.uuid4().hex
        self._put(
            "task_logs", ["task_id"],
            {"task_id": task, "task_name": name, "start_time": int(time.time()), "end_time": None, "status": "RUNNING", "details": details},
        )
        return task

    def end_task(self, task: str, status: str, details: str = "") -> None:
        self._put("task_logs", ["task_id"], {"task_id": task, "end_time": int(time.time()), "status": status, "details": details})

    # offsets

    def ensure_offset(self, path: str, entity_type: str, category: str, keys: list[str]) -> None:
        """Known already: its version stays."""
        self._put("ingestion_offsets", ["table_path"], {"table_path": path, "entity_type": entity_type, "category": category, "primary_keys": json.dumps(keys)})

    def set_offset(self, path: str, version: int) -> None:
        with self.lock, self.db:
            self.db.execute("UPDATE ingestion_offsets SET last_version = ? WHERE table_path = ?", (version, path))

    def offset(self, path: str) -> int:
        row = self._get("ingestion_offsets", table_path=path)
        return row["last_version"] if row else -1
