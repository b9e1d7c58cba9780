"""Snapshots: nodes and edges as Parquet, and a manifest beside them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .. import errors as err
from ..model import Kind
from ..operators.graph import Graph
from .store import delete_folder, folder_exists, written

VERSION = 1


def save(graph: Graph, path: str) -> None:
    """Write a new snapshot; an existing one isn't overwritten.

    The manifest comes last and makes it a snapshot. What a run that died left
    without a manifest is written over.
    """
    if exists(graph.spark, path):
        raise PersistFailure(path=path, cause="there is a snapshot")
    for part in ("nodes", "edges", "manifest"):
        delete_folder(graph.spark, f"{path}/{part}")
    nodes, edges = written(graph.nodes, f"{path}/nodes"), written(graph.edges, f"{path}/edges")
    header = {"format": "weft", "version": VERSION, "kind": graph.kind.name, "nodes": graph.nodes.schema.jsonValue(), "edges": graph.edges.schema.jsonValue(), "node_count": nodes.count(), "edge_count": edges.count()}
    graph.spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole snapshot is there: its manifest was committed."""
    return folder_exists(spark, f"{path}/manifest/_SUCCESS")


def read_header(spark: SparkSession, path: str) -> dict:
    """The manifest alone."""
    if not folder_exists(spark, f"{path}/manifest"):
        raise PersistFailure(path=path, cause="no manifest")
    rows = spark.read.text(f"{path}/manifest").collect()
    try:
        header = json.loads(rows[0][0])
    except (IndexError, ValueError) as e:
        raise PersistFailure(path=path, cause=str(e)[:200]) from e
    if header.get("format") != "weft" or header.get("version") != VERSION:
        raise PersistFailure(path=path, cause="another format or version")
    return header


class PersistFailure(err.PersistError): ...


def load(spark: SparkSession, path: str, kind: Kind | None = None, node_schema: T.StructType | None = None, edge_schema: T.StructType | None = None) -> Graph:
    """Read a snapshot; a kind or value schema that is named must be the stored one."""
    header = read_header(spark, path)
    if kind is not None and header["kind"] != kind.name:
        raise PersistFailure(path=path, cause=f"kind {header['kind']}")
    stored = {k: T.StructType.fromJson(header[k]) for k in ("nodes", "edges")}
    for given, k in ((node_schema, "nodes"), (edge_schema, "edges")):
        if given is not None and [(f.name, f.dataType) for f in given] != [(f.name, f.dataType) for f in stored[k]]:
            raise PersistFailure(path=path, cause=f"{k} have another schema")
    return Graph(Kind[header["kind"]], spark.read.schema(stored["nodes"]).parquet(f"{path}/nodes"), spark.read.schema(stored["edges"]).parquet(f"{path}/edges"))
