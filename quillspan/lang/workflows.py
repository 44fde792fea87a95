"""Workflow definitions and transfer commands as tables: nothing runs here, they are read to rows."""

from __future__ import annotations

import shlex
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from quillspan.lang.parser import LanguageError


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def workflow(xml: str) -> tuple[list[tuple[str, str, str | None]], list[tuple[str, str, str]]]:
    """Nodes (name, kind, what runs) and edges (from, to, kind) of a workflow. Edges are ok, error, start, fork, join or case."""
    root = ET.fromstring(xml)
    if _bare(root.tag) != "workflow-app":
        raise LanguageError(f"a workflow begins with workflow-app, not {_bare(root.tag)}")
    nodes, edges = [], []
    for n in root:
        kind, name = _bare(n.tag), n.get("name") or _bare(n.tag)
        if kind not in ("start", "end", "kill", "action", "fork", "join", "decision"):
            continue
        inner = next((_bare(c.tag) for c in n if _bare(c.tag) not in ("ok", "error")), None) if kind == "action" else None
        nodes.append((name, kind, inner))
        if kind in ("start", "join"):
            edges.append((name, n.get("to"), kind))
        for c in n.iter():
            tag = _bare(c.tag)
            if kind == "action" and tag in ("ok", "error"):
                edges.append((name, c.get("to"), tag))
            elif kind == "fork" and tag == "path":
                edges.append((name, c.get("start"), "fork"))
            elif kind == "decision" and tag in ("case", "default"):
                edges.append((name, c.get("to"), "case"))
    known = {n for n, _, _ in nodes}
    lost = [e for e in edges if e[1] not in known]
    if lost:
        raise LanguageError(f"{lost[0][0]} leads to {lost[0][1]}, which does not exist")
    return nodes, edges


def workflow_tables(spark: SparkSession, xml: str) -> tuple[DataFrame, DataFrame]:
    """The same as DataFrames; edges as (src, dst, kind), fit for the graph operators (run order over all but error edges)."""
    nodes, edges = workflow(xml)
    return spark.createDataFrame(nodes, "node string, kind string, runs string"), spark.createDataFrame(edges, "src string, dst string, kind string")


#: Options of a transfer command that take no value.
_FLAGS = {"verbose", "append", "delete-target-dir", "direct", "hive-import", "hive-overwrite", "compress", "as-parquetfile", "as-textfile", "as-avrodatafile", "batch"}


def transfer(command: str) -> dict:
    """A Sqoop import or export command as a descriptor: tool, connect, table or query, columns, where, target, split, mappers, other options."""
    words = shlex.split(command.replace("\\\n", " "))
    if words[:1] == ["sqoop"]:
        words = words[1:]
    if not words or words[0] not in ("import", "export"):
        raise LanguageError(f"only import and export are known, not {words[:1]}")
    options, i = {}, 1
    while i < len(words):
        w = words[i]
        if not w.startswith("-"):
            raise LanguageError(f"{w!r} is no option")
        key = {"m": "num-mappers", "P": "password-prompt", "e": "query"}.get(w.lstrip("-"), w.lstrip("-"))
        if key in _FLAGS or key == "password-prompt" or i + 1 == len(words) or words[i + 1].startswith("--"):
            options[key] = "true"
            i += 1
        else:
            options[key] = words[i + 1]
            i += 2
    if "connect" not in options:
        raise LanguageError("a transfer needs --connect")
    named = {"tool": words[0], "connect": options.pop("connect"), "source": options.pop("table", None) or options.pop("query", None), "columns": options.pop("columns", None), "where": options.pop("where", None), "target": options.pop("target-dir", None) or options.pop("export-dir", None),
             "split_by": options.pop("split-by", None), "mappers": int(options.pop("num-mappers", 4))}
    return named | {"options": options}
