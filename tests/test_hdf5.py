"""The HDF5 source: round trips, pushed row ranges, commits, listing. Without h5py a stub stands in for it."""

import glob
import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

STUB = os.path.join(ROOT, "tests/stubs/h5py_stub")


def test_without_h5py_it_says_so():
    if importlib.util.find_spec("h5py") is not None:
        pytest.skip("h5py is present")
    code = "from tessella.sources.hdf5 import register\ntry:\n    register(None)\nexcept RuntimeError as e:\n    print(e)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout
    assert "needs h5py" in out


@pytest.fixture(scope="module")
def done(tmp_path_factory):
    """The checks below run in a process of their own, whose workers find h5py or the stub."""
    place = tmp_path_factory.mktemp("hdf5")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, *([STUB] if importlib.util.find_spec("h5py") is None else []), os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run([sys.executable, os.path.join(ROOT, "tests/stubs/hdf5_run.py"), str(place)], capture_output=True, text=True, env=env, cwd=ROOT, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    return place, eval(run.stdout.strip().splitlines()[-1])


def test_round_trip(done):
    _, r = done
    assert r["back"] == r["entries"] and r["files"] > 1 and r["splits"] > r["files"]
    assert r["appended"] == 2 * len(r["entries"]) and r["overwritten"] == len(r["entries"])


def test_row_ranges_are_pushed(done):
    place, r = done
    assert r["part"] == [e for e in r["entries"] if 20 <= e[0] < 23]
    if importlib.util.find_spec("h5py") is None:
        # Values read while planning and reading the range: only those of its rows.
        got = sum(int(b) - int(a) for f in glob.glob(f"{place}/ranged/*.reads") for kind, a, b in map(str.split, open(f)) if kind == "data")
        assert got == len(r["part"])


def test_a_failed_job_leaves_nothing(done):
    place, r = done
    assert r["failed"] and not glob.glob(f"{place}/failed/*.h5")


def test_listing_joins_with_paths(done):
    _, r = done
    kinds = {(o, k) for o, k, *_ in r["objects"]}
    assert kinds == {("/", "group"), ("matrix", "group"), *((f"matrix/{d}", "dataset") for d in ("indices", "data", "rows", "indptr"))}
    assert all(a == '{"format": "compressed rows"}' for o, _, _, a in r["objects"] if o == "/")
