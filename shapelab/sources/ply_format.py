"""PLY files as a data source of Spark: `spark.read.format("ply")` and `df.write.format("ply")`.

Reading, a partition per file: option `element` is vertex (default), face or edge; binary files of both byte orders
and ascii ones, colours or not; what a file lacks is null. Writing, a file per row: columns name, vertices (array of
structs of VERTEX, normals and colours null if there are none), and if there are any faces (array of arrays of vertex
ids) and edges (array of structs v0, v1); option `encoding` is binary (default) or ascii. Folders may be in any store
that pyarrow knows. A task that is run again writes the same files again. Register with `spark.dataSource.register`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The format's names of types.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
PLACES, COLOURS = ("x", "y", "z", "nx", "ny", "nz"), ("red", "green", "blue")
VERTEX = "x float, y float, z float, nx float, ny float, nz float, red short, green short, blue short"
SCHEMAS = {
    "vertex": f"path string, id int, {VERTEX}",
    "face": "path string, id int, vertices array<int>",
    "edge": "path string, id int, v0 int, v1 int, red short, green short, blue short",
}


def elements(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple]]], int]:
    """The encoding; (name, count, properties) in order, a property being (name, type) or (name, type of counts, type); where the body begins."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    encoding, found = "", []
    for line in data[:end].decode("latin-1").splitlines():
        part = line.split()
        if part[:1] == ["format"]:
            encoding = part[1]
        elif part[:1] == ["element"]:
            found.append((part[1], int(part[2]), []))
        elif part[:2] == ["property", "list"]:
            found[-1][2].append((part[4], TYPES[part[2]], TYPES[part[3]]))
        elif part[:1] == ["property"]:
            found[-1][2].append((part[2], TYPES[part[1]]))
    return encoding, found, data.index(b"\n", end) + 1


def values(data: bytes, wanted: str) -> Iterator[dict]:
    """The rows of an element, by property."""
    encoding, found, at = elements(data)
    words = data[at:].split() if encoding == "ascii" else None
    order, at = (">" if encoding == "binary_big_endian" else "<"), 0 if words is not None else at
    for name, count, props in found:
        flat = all(len(p) == 2 for p in props)
        if flat and words is None:
            kind = np.dtype([(p[0], order + p[1]) for p in props])
            if name == wanted:
                for x in np.frombuffer(data, kind, count, at):
                    yield dict(zip(kind.names, x.item()))
            at += count * kind.itemsize
        else:
            for _ in range(count):
                row = {}
                for p in props:
                    if words is not None:
                        n = int(words[at]) if len(p) == 3 else 1
                        at += len(p) == 3
                        got = [(float if p[-1][0] == "f" else int)(w) for w in words[at : at + n]]
                        at += n
                    else:
                        n = 1
                        if len(p) == 3:
                            n = int(np.frombuffer(data, order + p[1], 1, at)[0])
                            at += np.dtype(p[1]).itemsize
                        got = np.frombuffer(data, order + p[-1], n, at).tolist()
                        at += n * np.dtype(p[-1]).itemsize
                    row[p[0]] = got if len(p) == 3 else got[0]
                if name == wanted:
                    yield row
        if name == wanted:
            return


def encoded(vertices: list, faces: list | None, edges: list | None, ascii_: bool) -> bytes:
    """A shape as a PLY file; normals and colours are written if the first vertex has them."""
    names = [c for c in (*PLACES, *COLOURS) if not vertices or c in ("x", "y", "z") or vertices[0][c] is not None]
    kinds = [("uchar" if c in COLOURS else "float", c) for c in names]
    lines = ["ply", f"format {'ascii' if ascii_ else 'binary_little_endian'} 1.0", f"element vertex {len(vertices)}", *[f"property {k} {c}" for k, c in kinds]]
    rows = [tuple(v[c] for c in names) for v in vertices]
    if faces is not None:
        lines += [f"element face {len(faces)}", "property list int int vertex_indices"]
    if edges is not None:
        lines += [f"element edge {len(edges)}", "property int vertex1", "property int vertex2"]
    ends = [(e["v0"], e["v1"]) for e in edges or []]
    head = ("\n".join([*lines, "end_header"]) + "\n").encode()
    if ascii_:
        body = [*rows, *[(len(f), *f) for f in faces or []], *ends]
        return head + "".join(" ".join(repr(x) for x in r) + "\n" for r in body).encode()
    body = np.array(rows, np.dtype([(c, "<" + TYPES[k]) for k, c in kinds])).tobytes()
    body += b"".join(np.array([len(f), *f], "<i4").tobytes() for f in faces or [])
    return head + body + np.array(ends, "<i4").tobytes()


def _store(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PlyFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PlyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.element = options["path"], options.get("element", "vertex")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = _store(self.folder)
        one = store.get_file_info(path)
        if one.type == fs.FileType.File:
            return [PlyFile(one.path)]
        files = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [PlyFile(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(".ply")] or [PlyFile("")]

    def read(self, partition: PlyFile) -> Iterator[tuple]:
        if not partition.path:
            return
        with _store(self.folder)[0].open_input_stream(partition.path) as f:
            data = f.read()
        for i, x in enumerate(values(data, self.element)):
            if self.element == "face":
                yield partition.path, i, x.get("vertex_indices", x.get("vertex_index"))
                continue
            colours = [x.get(c) for c in COLOURS]
            yield (partition.path, i, *([x["vertex1"], x["vertex2"]] if self.element == "edge" else [x.get(c) for c in PLACES]), *colours)


class PlyWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.ascii = options["path"], options.get("encoding", "binary") == "ascii"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        for r in rows:
            has = r.asDict()
            if not r.name or "/" in r.name or r.name.startswith("."):
                raise ValueError(f"no name of a file: {r.name!r}")
            with store.open_output_stream(f"{folder.rstrip('/')}/{r.name}.ply") as f:
                f.write(encoded(r.vertices or [], has.get("faces"), has.get("edges"), self.ascii))
        return WriterCommitMessage()


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("element", "vertex")]

    def reader(self, schema) -> PlyReader:  # noqa: ANN001
        return PlyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PlyWriter:  # noqa: ANN001
        return PlyWriter(dict(self.options))
