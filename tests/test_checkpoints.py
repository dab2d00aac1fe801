"""Tensor archives: both layouts, strides and kinds, and refusal of everything else."""

import io
import pickle
import sys
import types
import zipfile
from collections import OrderedDict

import numpy as np
import pytest

from vialattice.sources import checkpoints


def rebuild(*_):
    raise AssertionError("never called")


class Storage:
    def __init__(self, key, array):
        self.key, self.array = key, array


class Tensor:
    def __init__(self, storage, offset, size, stride):
        self.given = (storage, offset, size, stride, False, OrderedDict())

    def __reduce__(self):
        return sys.modules["torch._utils"]._rebuild_tensor_v2, self.given


@pytest.fixture
def names(monkeypatch):
    """Modules of the names that the format uses, to write files with."""
    top, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    rebuild.__module__, rebuild.__qualname__, rebuild.__name__ = "torch._utils", "_rebuild_tensor_v2", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = rebuild
    for n in checkpoints.STORAGES:
        setattr(top, n, type(n, (), {"__module__": "torch"}))
    monkeypatch.setitem(sys.modules, "torch", top)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    return top


def archive(held, top, cut=0):
    out, stores = io.BytesIO(), {}

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            if isinstance(x, Storage):
                stores[x.key] = x.array
                kind = next(n for n, k in checkpoints.STORAGES.items() if np.dtype(k) == x.array.dtype)
                return ("storage", getattr(top, kind), x.key, "cpu", len(x.array))
            return None

    Pickler(out, 2).dump(held)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("best/data.pkl", out.getvalue())
        z.writestr("best/version", "3")
        for key, array in stores.items():
            z.writestr(f"best/data/{key}", array.tobytes()[: len(array.tobytes()) - cut])
    return data.getvalue()


def states():
    a = np.arange(12, dtype="<f4")
    s = Storage("0", a)
    state = OrderedDict(a=Tensor(s, 0, (3, 4), (4, 1)), b=Tensor(s, 0, (4, 3), (1, 4)), c=Tensor(s, 5, (), ()), d=Tensor(Storage("1", np.array([7, 8], "<i8")), 1, (1,), (1,)), e=Tensor(s, 2, (0, 3), (3, 1)))
    want = {"a": a.reshape(3, 4), "b": a.reshape(3, 4).T, "c": np.float32(5), "d": np.array([8]), "e": np.zeros((0, 3))}
    return state, want


def test_both_layouts(spark, tmp_path, names):
    state, want = states()
    (tmp_path / "own.pt").write_bytes(archive({"epoch": 7, "model_state_dict": state, "best_metric": 0.5, "config": {"model": {"embed_dim": 128}}}, names))
    (tmp_path / "joint.pt").write_bytes(archive({"lane_encoder_state_dict": state, "model_state_dict": OrderedDict(), "config": {}}, names))
    rows = checkpoints.tensors(spark, str(tmp_path)).collect()
    assert {(r["path"].rpartition("/")[2], r["layout"], r["epoch"], r["best"]) for r in rows} == {("own.pt", "model_state_dict", 7, 0.5), ("joint.pt", "lane_encoder_state_dict", None, None)}
    for r in rows:
        assert np.array_equal(np.array(r["numbers"]).reshape(r["shape"]), want[r["name"]]) and r["kind"] == str(np.asarray(want[r["name"]]).dtype if r["name"] not in "de" else {"d": "int64", "e": "float32"}[r["name"]])
    one = checkpoints.weights(spark, str(tmp_path / "own.pt"))
    assert one.keys() == want.keys() and all(np.array_equal(one[n], want[n]) for n in want)


class Evil:
    def __reduce__(self):
        return print, ("run",)


def test_refusals(names, capsys):
    state, _ = states()
    for held in ({"model_state_dict": state, "x": Evil()}, Evil()):
        with pytest.raises(checkpoints.Refused):
            checkpoints.parse(archive(held, names))
    assert "run" not in capsys.readouterr().out
    s = Storage("0", np.zeros(4, "<f4"))
    for tensor in (Tensor(s, 0, (3, 2), (2, 1)), Tensor(s, 0, (2,), (-1,)), Tensor(s, -1, (1,), (1,)), Tensor(Storage("../x", np.zeros(1, "<f4")), 0, (1,), (1,))):
        with pytest.raises(checkpoints.Refused):
            checkpoints.parse(archive({"model_state_dict": {"t": tensor}}, names))
    with pytest.raises(checkpoints.Refused):
        checkpoints.parse(archive({"model_state_dict": state}, names, cut=4))
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    with pytest.raises(checkpoints.Refused):
        checkpoints.parse(empty.getvalue())
