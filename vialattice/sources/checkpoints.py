"""Reader of tensor checkpoints kept as a zip archive with a pickled index.

The index is read by an unpickler that knows tensors, their storages and plain containers, and refuses
every other name, so nothing in a file is run. Files are read through Spark, one in a task; two layouts are
known: a model's own state, and a joint state that holds the lane encoder's beside others.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Names of storages in the format, and their kinds.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?"}
#: Where a state lies, the joint layout first.
LAYOUTS = ("lane_encoder_state_dict", "model_state_dict")
TENSORS = "path string, layout string, epoch int, best double, name string, kind string, shape array<int>, numbers array<double>"


class Refused(ValueError):
    """The file names something that isn't a tensor or a plain container."""


def _tensor(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
    if any(s < 0 for s in (*size, *stride)) or offset < 0:
        raise Refused("a tensor of a negative size")
    reach = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) + 1
    if all(size) and reach > len(storage):
        raise Refused("a tensor beyond its storage")
    if not all(size):
        return np.zeros(size, storage.dtype)
    return np.lib.stride_tricks.as_strided(storage[offset:], size, tuple(s * storage.itemsize for s in stride)).copy()


class _Index(pickle.Unpickler):
    def __init__(self, data: bytes, archive: zipfile.ZipFile, root: str):
        super().__init__(io.BytesIO(data))
        self.archive, self.root = archive, root

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if module == "torch" and name in STORAGES:
            return name
        raise Refused(f"{module}.{name}")

    def persistent_load(self, pid) -> np.ndarray:
        what, kind, key, _, count = pid
        if what != "storage" or kind not in STORAGES or not str(key).isalnum():
            raise Refused(str(pid))
        out = np.frombuffer(self.archive.read(f"{self.root}/data/{key}"), STORAGES[kind])
        if len(out) < count:
            raise Refused("a storage that is cut off")
        return out


def parse(data: bytes) -> dict:
    """What a checkpoint holds, with tensors as arrays."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        index = next((n for n in archive.namelist() if n.endswith("/data.pkl") and n.count("/") == 1), None)
        if index is None:
            raise Refused("no index in the archive")
        return _Index(archive.read(index), archive, index.partition("/")[0]).load()


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """A row for each tensor of each file's state: layout, epoch and best metric where given, name, kind, shape, numbers."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in stream:
            for at, data in zip(t.path, t.content, strict=True):
                held = parse(bytes(data))
                layout = next((k for k in LAYOUTS if k in held), None)
                if layout is None:
                    raise Refused(f"{at} has no state of a known layout")
                rows = [(at, layout, held.get("epoch"), held.get("best_metric"), n, str(a.dtype), list(a.shape), a.astype(float).ravel().tolist()) for n, a in held[layout].items()]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TENSORS.split(", ")]).astype({"epoch": "Int64", "best": float})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TENSORS)


def weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """One file's tensors by name, ready for the forward passes; a model is small."""
    rows = tensors(spark, path).collect()
    if len({r["path"] for r in rows}) > 1:
        raise ValueError("more than one file")
    return {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in rows}
