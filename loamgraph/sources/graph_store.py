"""A graph kept for searches: nodes by id, edges twice, by their source and by their target, each cut into buckets and sorted.

A step from a few nodes reads the files of their buckets only, and of those the row groups that can hold them. ``Frames`` gives the same
operations over plain frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.session import SMALL
from loamgraph.sources.store import VersionedTable

#: Largest frame that is sent to every executor; beyond it joins shuffle.
BROADCAST_ROWS = 100_000
ENDS = {"out": ("from_node_id", "to_node_id"), "in": ("to_node_id", "from_node_id")}
EDGE = ("id", "label", "from_node_id", "to_node_id", "from_node_type", "to_node_type")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Frames:
    """``nodes``: id, label, ...; ``edges``: id, label, from_node_id, to_node_id, ..."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges
        self.spark = edges.sparkSession

    def known(self, ids: DataFrame, rows: int) -> DataFrame:
        """id and label of the nodes in ``ids`` (column id)."""
        return self.nodes.select("id", "label").join(small(ids.select("id"), rows), "id", "left_semi")

    def step(self, side: str, front: DataFrame, rows: int, labels: list[str] | None = None) -> DataFrame:
        """The edges of the nodes in ``front`` (column id, and others that ride along): id, label, from_node_id, to_node_id, the other columns."""
        return self._stepped(self.edges, side, front, rows, labels)

    @staticmethod
    def _stepped(edges: DataFrame, side: str, front: DataFrame, rows: int, labels: list[str] | None) -> DataFrame:
        edges = edges.filter(F.col("label").isin(labels)) if labels else edges
        return edges.select("id", "label", "from_node_id", "to_node_id").join(small(front.withColumnRenamed("id", ENDS[side][0]), rows), ENDS[side][0])


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32, hidden: tuple[str, ...] = ()):
        self.spark, self.root, self.buckets, self.hidden = spark, root, buckets, hidden
        self.node_table = VersionedTable(spark, f"{root}/nodes", ["id"], buckets)
        self.edge_tables = {side: VersionedTable(spark, f"{root}/{side}", ["id"], buckets, by=[own]) for side, (own, _) in ENDS.items()}

    def hiding(self, labels: list[str]) -> GraphStore:
        """The same graph without the nodes of these labels."""
        return GraphStore(self.spark, self.root, self.buckets, tuple(labels))

    def exists(self) -> bool:
        return all(t.exists() for t in (self.node_table, *self.edge_tables.values()))

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """New rows replace those with their ids; an edge whose ends have changed must be deleted first."""
        if nodes is not None:
            self.node_table.write(nodes.select("id", "label", "properties"))
        if edges is not None:
            for table in self.edge_tables.values():
                table.write(edges.select(*EDGE))

    def delete(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """By their ids (first column)."""
        for rows, tables in ((nodes, [self.node_table]), (edges, self.edge_tables.values())):
            if rows is not None:
                for table in tables:
                    table.delete_matching(rows, ["id"])

    @property
    def nodes(self) -> DataFrame:
        return self._shown(self.node_table.read())

    def _shown(self, nodes: DataFrame) -> DataFrame:
        return nodes.filter(~F.col("label").isin(*self.hidden)) if self.hidden else nodes

    @property
    def edges(self) -> DataFrame:
        return self.edge_tables["out"].read()

    def nodes_of(self, ids: list[str]) -> DataFrame:
        """Whole rows."""
        return self._shown(self.node_table.read_of(ids))

    def known(self, ids: DataFrame, rows: int) -> DataFrame:
        if rows > SMALL:
            return Frames(self.nodes, self.edges).known(ids, rows)
        return self.nodes_of([r["id"] for r in ids.select("id").collect()]).select("id", "label")

    def step(self, side: str, front: DataFrame, rows: int, labels: list[str] | None = None) -> DataFrame:
        if rows > SMALL:
            return Frames._stepped(self.edge_tables[side].read(), side, front, rows, labels)
        ids = [r["id"] for r in front.select("id").collect()]
        return Frames._stepped(self.edge_tables[side].read_of(ids), side, front, rows, labels)
