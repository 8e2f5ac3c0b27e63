"""Data sources that write: GraphML and layout JSON, by tasks, as folders of part files.

Every task attempt writes files of its own below ``_temporary``; the names of those that count travel in commit messages, and the
commit moves them into place. What a lost or repeated attempt has written is never named and goes with the temporary folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NODE, EDGE = "node:", "edge:"
_TYPES = {"string": "string", "long": "long", "integer": "int", "double": "double", "boolean": "boolean"}


@dataclass
class Written(WriterCommitMessage):
    names: list


def _place(path: str):
    """File system and path of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


class PartWriter(DataSourceWriter):
    """Writes rows as files of at most ``per_file`` rows; ``documents`` gives the text of a file."""

    suffix, per_file = "txt", 10_000

    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.fields, self.overwrite, self.job = path, [(f.name, f.dataType.typeName()) for f in schema], overwrite, uuid.uuid4().hex

    def document(self, rows: list) -> Iterator[str]:
        raise NotImplementedError

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        files, base = _place(self.path)
        task = TaskContext.get()
        attempt, names, held = uuid.uuid4().hex[:8], [], []

        def put():
            name = f"part-{task.partitionId():05d}-{len(names):05d}-{attempt}.{self.suffix}"
            files.create_dir(f"{base}/_temporary/{self.job}")
            with files.open_output_stream(f"{base}/_temporary/{self.job}/{name}") as out:
                for text in self.document(held):
                    out.write(text.encode())
            names.append(name)
            held.clear()

        for row in iterator:
            held.append(row)
            if len(held) == self.per_file:
                put()
        if held:
            put()
        return Written(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, base = _place(self.path)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.is_file:
                    files.delete_file(old.path)
        files.create_dir(base)
        for message in messages:
            for name in message.names if message else []:
                files.move(f"{base}/_temporary/{self.job}/{name}", f"{base}/{name}")
        self.abort(messages)
        with files.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        from pyarrow import fs

        files, base = _place(self.path)
        if files.get_file_info(f"{base}/_temporary/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/_temporary/{self.job}")


class GraphmlWriter(PartWriter):
    """Every file is a document with the keys of all attributes and some of the nodes and edges."""

    suffix = "graphml"

    def document(self, rows):
        keys = [(f"d{k}", "node" if c.startswith(NODE) else "edge", c, _TYPES.get(t, "string")) for k, (c, t) in enumerate(f for f in self.fields if f[0].startswith((NODE, EDGE)))]
        yield '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        for k, kind, c, t in keys:
            yield f'<key id="{k}" for="{kind}" attr.name={quoteattr(c[5:])} attr.type="{t}"/>\n'
        yield '<graph edgedefault="undirected">\n'
        for r in rows:
            kind = "node" if r["id"] is not None else "edge"
            data = "".join(f'<data key="{k}">{escape(str(r[c]).lower() if t == "boolean" else str(r[c]))}</data>' for k, of, c, t in keys if of == kind and r[c] is not None)
            head = f"id={quoteattr(r['id'])}" if kind == "node" else f"source={quoteattr(r['src'])} target={quoteattr(r['dst'])}"
            yield f"<{kind} {head}>{data}</{kind}>\n"
        yield "</graph>\n</graphml>\n"


class LayoutWriter(PartWriter):
    """Every file is a layout document with some of the nodes, whose numbers stand in ``ords``, and some of the links."""

    suffix = "json"

    def document(self, rows):
        nodes, links = [r for r in rows if r["ord"] is not None], [r for r in rows if r["ord"] is None]
        doc = {
            "scale": 1,
            "nodes": {"positions": [list(r["position"]) for r in nodes], "labels": [r["label"] for r in nodes], "ords": [r["ord"] for r in nodes]},
            "links": {r["label"]: {"end_points": [r["a"], r["b"]], "points": [list(p) for p in r["points"] or []], "radius": r["radius"], "weight": r["weight"]} for r in links},
        }
        yield json.dumps(doc, ensure_ascii=False)


class _Sink(DataSource):
    def writer(self, schema, overwrite):
        return self.kind(self.options["path"], schema, overwrite)


class GraphmlSink(_Sink):
    kind = GraphmlWriter

    @classmethod
    def name(cls) -> str:
        return "graphml"


class LayoutSink(_Sink):
    kind = LayoutWriter

    @classmethod
    def name(cls) -> str:
        return "layout"


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """nodes (id, attributes) and edges (src, dst, attributes) as a folder of GraphML documents, written by tasks; files=1 makes one.

    Attributes are typed by their columns (others than string, long, int, double and boolean are written as text); nulls are left out.
    Ids are written as text.
    """
    text = lambda df, c: F.col(c).cast("string").alias(c)
    known = lambda df, c: F.col(c) if df.schema[c].dataType.typeName() in _TYPES else F.col(c).cast("string")
    n = nodes.where("id IS NOT NULL").select(text(nodes, "id"), *[known(nodes, c).alias(NODE + c) for c in nodes.columns if c != "id"])
    e = edges.select(text(edges, "src"), text(edges, "dst"), *[known(edges, c).alias(EDGE + c) for c in edges.columns if c not in ("src", "dst")])
    rows = n.unionByName(e, allowMissingColumns=True)
    nodes.sparkSession.dataSource.register(GraphmlSink)
    (rows.coalesce(files) if files else rows).write.format("graphml").mode(mode).save(path)


def write_layout(nodes: DataFrame, links: DataFrame, path: str, mode: str = "overwrite") -> None:
    """nodes (ord, label, x, y, z) and links (label, a, b, radius, weight, points) as a folder of layout documents; labels of links are keys."""
    n = nodes.select("ord", "label", F.array("x", "y", "z").alias("position"))
    rows = n.unionByName(links.select("label", "a", "b", "radius", "weight", "points"), allowMissingColumns=True)
    nodes.sparkSession.dataSource.register(LayoutSink)
    rows.write.format("layout").mode(mode).save(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """Numbers as plain text, a row a line, in order of the first column."""
    first = trace.columns[0]
    rows = trace.repartitionByRange(first).sortWithinPartitions(first)
    rows.select(F.concat_ws(" ", *[F.format_string("%.18e", F.col(c).cast("double")) for c in trace.columns]).alias("value")).write.text(path)
