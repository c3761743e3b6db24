"""Safetensors files as a Spark data source, and blobs as files: A1, A2, A5, A6, A9-A16, A23, A25, K20.

A file is an 8-byte little-endian header length, a JSON header (name -> dtype, shape, data_offsets) and raw bytes. The reader deals
files to partitions, so many in each; a filter on ``name`` is pushed into it, so that other payloads aren't read. Files are read and
written where they lie, by ``open``: the root is a folder that all machines mount under one path. Another kind of store is an error
(``root_of``); files of up to 2 GB in any store that Spark reads come by ``read_binary``, whole.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.lineage import settle
from ..operators.store import BLOB

SCHEMA = "file string, name string, dtype string, shape array<bigint>, data_offset bigint, data_len bigint, payload binary"
# Names of element kinds in file headers.
KINDS = {"BOOL": "bool", "U8": "uint8", "I8": "int8", "I16": "int16", "U16": "uint16", "F16": "float16", "BF16": "bfloat16", "I32": "int32", "U32": "uint32", "F32": "float32", "I64": "int64", "U64": "uint64", "F64": "float64"}


# Bytes of one element.
WIDTH = {"BOOL": 1, "U8": 1, "I8": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}
ENGINE = "loomstore 1"
CODECS = ("xor-planes",)


def root_of(uri: str) -> str:
    """The folder that a path or file: URI names; an error for any other scheme"""
    from urllib.parse import unquote, urlsplit

    at = urlsplit(uri)
    if at.scheme not in ("", "file") or at.netloc:
        raise ValueError(f"{uri}: files are written and scanned in a mounted folder only")
    return (unquote(at.path) if at.scheme else uri).rstrip("/") or "/"


def read_header(f) -> tuple[dict, dict, int]:
    """(header without metadata, metadata, where the data start)"""
    n = struct.unpack("<Q", f.read(8))[0]
    head = json.loads(f.read(n))
    return head, head.pop("__metadata__", None) or {}, 8 + n


def slots(path: str, names: set[str] | None = None, f=None) -> Iterator[tuple]:
    """The tensors of a file, in order of name. A length that isn't that of the shape, or a file that ends too soon, is an error."""
    with open(path, "rb") if f is None else f as f:
        head, _, base = read_header(f)
        for name in sorted(head):
            if names is not None and name not in names:
                continue
            h = head[name]
            a, b = h["data_offsets"]
            if h["dtype"] in WIDTH and b - a != WIDTH[h["dtype"]] * math.prod(h["shape"]):
                raise ValueError(f"{path}: {name} has {b - a} bytes, which is not its shape's number")
            f.seek(base + a)
            data = f.read(b - a)
            if len(data) != b - a:
                raise ValueError(f"{path}: {name} is cut off")
            yield path, name, KINDS.get(h["dtype"], "torch.unknown"), h["shape"], a, b - a, data


def probe(path: str) -> tuple[str | None, str | None]:
    """(codec, base id) by the header alone. An unknown codec is none, and the file counts as raw; so does an empty base id."""
    with open(path, "rb") as f:
        meta = read_header(f)[1]
    return meta.get("codec") if meta.get("codec") in CODECS else None, meta.get("base_tensor_id") or None


def load_blob(path: str) -> dict:
    """A blob as a row of the store (see operators.store.BLOB), raw or compressed; its payload by pick_key"""
    with open(path, "rb") as f:
        head, meta, base = read_header(f)
        name = pick_key(sorted(head), {n: h["shape"] for n, h in head.items()})
        a, b = head[name]["data_offsets"]
        f.seek(base + a)
        data = f.read(b - a)
    if len(data) != b - a:
        raise ValueError(f"{path}: {name} is cut off")
    out = {"id": meta.get("id") or os.path.basename(path).removesuffix(".safetensors"), "codec": None, "base_id": None, "item_size": None, "level": None, "data": data}
    if meta.get("codec") in CODECS:
        return out | {"dtype": meta["target_dtype"], "shape": json.loads(meta["target_shape"]), "codec": meta["codec"], "base_id": meta["base_tensor_id"], "item_size": int(meta.get("item_size", 2)), "level": int(meta.get("level", 3))}
    return out | {"dtype": KINDS.get(head[name]["dtype"], "torch.unknown"), "shape": head[name]["shape"]}


def save_blob(root: str, row) -> int:
    """One row of the store as a file; its size on disk"""
    path = blob_path(root, row["id"])
    if row["codec"] is None:
        meta = {"id": row["id"], "shape": json.dumps(list(row["shape"])), "dtype": row["dtype"], "engine_version": ENGINE}
        write_file(path, {"tensor": (row["dtype"], list(row["shape"]), bytes(row["data"]))}, meta)
    else:
        meta = {"id": row["id"], "codec": row["codec"], "base_tensor_id": row["base_id"], "item_size": str(row["item_size"]), "level": str(row["level"]), "target_shape": json.dumps(list(row["shape"])), "target_dtype": row["dtype"], "engine_version": ENGINE}
        write_file(path, {"tensor": ("uint8", [len(row["data"])], bytes(row["data"]))}, meta)
    return os.path.getsize(path)


def write_file(path: str, tensors: dict[str, tuple[str, list[int], bytes]], metadata: dict[str, str] | None = None) -> None:
    """Name -> (kind, shape, bytes), in order of name; written beside and renamed"""
    back = {v: k for k, v in KINDS.items()}
    head, at = {"__metadata__": metadata} if metadata else {}, 0
    for name in sorted(tensors):
        kind, shape, data = tensors[name]
        head[name] = {"dtype": back[kind], "shape": [int(x) for x in shape], "data_offsets": [at, at + len(data)]}
        at += len(data)
    raw = json.dumps(head).encode()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"  # two tasks may write the same content at once
    with open(part, "wb") as f:
        f.write(struct.pack("<Q", len(raw)) + raw + b"".join(tensors[n][2] for n in sorted(tensors)))
    os.replace(part, path)


def pick_key(names: list[str], shapes: dict[str, list[int]], shape: list[int] | None = None) -> str:
    """A10: `tensor`, else one of that shape, else the first that is no fingerprint"""
    if "tensor" in names:
        return "tensor"
    same = [n for n in names if shape is not None and shapes[n] == shape]
    rest = [n for n in names if "fingerprint" not in n and not n.startswith("_")]
    return (same or rest or names)[0]


def blob_path(root: str, tensor_id: str) -> str:
    """A5"""
    if not tensor_id or "/" in tensor_id or "\\" in tensor_id or ".." in tensor_id:
        raise ValueError("not a tensor id")
    return f"{root}/blobs/{tensor_id[:2]}/{tensor_id[2:4]}/{tensor_id}.safetensors"


class _Files(InputPartition):
    #: Of a partition. One more is begun when the next file would pass either.
    MOST, BYTES = 512, 64 << 20

    def __init__(self, paths: list[str]):
        super().__init__(paths)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.names = path, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                got = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = got if self.names is None else self.names & got
            else:
                yield f

    def partitions(self):
        if os.path.isfile(self.path):
            return [_Files([self.path])]
        out, room = [], 0
        for path in (os.path.join(d, x) for d, _, files in sorted(os.walk(self.path)) for x in sorted(files) if x.endswith(".safetensors")):
            n = os.path.getsize(path)
            if not out or len(out[-1]) == _Files.MOST or n > room:
                out.append([])
                room = _Files.BYTES
            out[-1].append(path)
            room -= n
        return [_Files(paths) for paths in out]

    def read(self, partition):
        for path in partition.value:
            yield from slots(path, self.names)


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(root_of(self.options["path"]))


def read(spark, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SafetensorsSource)
    return spark.read.format("safetensors").load(path)


def read_binary(spark, path: str, names: set[str] | None = None) -> DataFrame:
    """The rows of SCHEMA from files in any store that Spark reads, each fetched whole: 2 GB at most"""
    import io

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(slots(p, names, io.BytesIO(raw.as_py())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _arrow_kinds())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _arrow_kinds() -> list:
    import pyarrow as pa

    return [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]


def write_blobs(blobs: DataFrame, root: str) -> DataFrame:
    """(id, size_bytes) of the store's rows as content-addressed files under a mounted root; equal ids are one file. The files are there when the result is."""
    root = root_of(root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.string()), pa.array([save_blob(root, r) for r in rows], pa.int64())], names=["id", "size_bytes"])

    return settle(blobs.dropDuplicates(["id"]).mapInArrow(run, "id string, size_bytes long"))


def inventory(spark, root: str) -> DataFrame:
    """(id, path, size_bytes) of the blobs under a root, in any store that Spark reads; names that are no ids are left out"""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", "true").load(f"{root}/blobs")
    name = F.regexp_extract("path", r"([^/]+)\.safetensors$", 1)
    return files.select(name.alias("id"), "path", F.col("length").alias("size_bytes")).filter(F.col("id").rlike("^[0-9a-f]+$"))


def find_blob(root: str, tensor_id: str) -> str:
    """Where a blob lies: the path of two levels, else the older one of one level; an error where there is neither"""
    new = blob_path(root, tensor_id)
    for path in (new, f"{root}/blobs/{tensor_id[:2]}/{tensor_id}.safetensors"):
        if os.path.exists(path):
            return path
    raise FileNotFoundError(new)


def load(spark, ids: DataFrame, root: str) -> DataFrame:
    """Ids (id) -> rows of the store from their files"""
    root = root_of(root)

    def run(batches):
        import pyarrow as pa

        kinds = {"id": pa.string(), "dtype": pa.string(), "shape": pa.list_(pa.int64()), "codec": pa.string(), "base_id": pa.string(), "item_size": pa.int32(), "level": pa.int32(), "data": pa.binary()}
        for batch in batches:
            rows = [load_blob(find_blob(root, i)) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in kinds} for r in rows], schema=pa.schema(list(kinds.items())))

    return ids.select("id").distinct().mapInArrow(run, BLOB)


def headers(spark, ids: DataFrame, root: str) -> DataFrame:
    """Ids (id) -> (tensor_id, codec, base_id) by the files' headers alone"""
    root = root_of(root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_pylist()
            got = [probe(find_blob(root, i)) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([c for c, _ in got], pa.string()), pa.array([b for _, b in got], pa.string())], names=["tensor_id", "codec", "base_id"])

    return ids.select("id").distinct().mapInArrow(run, "tensor_id string, codec string, base_id string")


def write_models(params: DataFrame, root: str) -> DataFrame:
    """Params (model, param, dtype, shape, payload, file) -> (model, file, param, bytes), each file written with its parameters in order, and an index beside a model's files where there are several.

    A tensor under two names is written for each. One task holds one file at a time.
    """
    root = root_of(root)

    def run(rows):
        import pandas as pd

        model, file = rows.model.iloc[0], rows.file.iloc[0]
        write_file(f"{root}/{model}/{file}", {p: (k, list(s), bytes(b)) for p, k, s, b in zip(rows.param, rows.dtype, rows["shape"], rows.payload)})
        return pd.DataFrame({"model": rows.model, "file": rows.file, "param": rows.param, "bytes": [len(b) for b in rows.payload]})

    def index(rows):
        import pandas as pd

        model = rows.model.iloc[0]
        rows = rows.sort_values("param")
        if rows.file.nunique() > 1:
            stem = rows.file.iloc[0].split("-")[0]
            body = {"metadata": {"total_size": int(rows.bytes.sum())}, "weight_map": dict(zip(rows.param, rows.file))}
            part = f"{root}/{model}/{uuid.uuid4().hex}.part"
            with open(part, "w") as f:
                json.dump(body, f, indent=2)
            os.replace(part, f"{root}/{model}/{stem}.safetensors.index.json")
        return pd.DataFrame({"model": [model]})

    run.__annotations__ = index.__annotations__ = {}
    done = settle(params.groupBy("model", "file").applyInPandas(run, "model string, file string, param string, bytes long"))
    settle(done.groupBy("model").applyInPandas(index, "model string"))
    return done
