"""Functions and broadcast values reach workers that can't import this package."""

import importlib
import inspect
import pickle
import pkgutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from palisade import llm
from palisade.llm import quality

MODULES = sorted(m.name for m in pkgutil.iter_modules(llm.__path__) if m.name != "queries")
LOAD = "import pickle, sys\nfor data in pickle.load(sys.stdin.buffer): pickle.loads(data)"


def load_elsewhere(data, tmp_path):
    got = subprocess.run([sys.executable, "-I", "-c", LOAD], input=pickle.dumps(data), cwd=tmp_path, capture_output=True, timeout=120)
    assert got.returncode == 0, got.stderr.decode()[-2000:]


@pytest.mark.parametrize("name", MODULES)
def test_functions(name, tmp_path):
    module = importlib.import_module(f"palisade.llm.{name}")
    own = [f for f in vars(module).values() if (inspect.isfunction(f) or inspect.isclass(f)) and f.__module__ == module.__name__]
    assert own
    load_elsewhere([cloudpickle.dumps(f) for f in own], tmp_path)


def test_broadcast_model(tmp_path):
    model = quality.Model(np.ones(quality.N_FEATURES), np.ones(quality.N_FEATURES), 2.0)
    load_elsewhere([pickle.dumps(model.parts())], tmp_path)
    again = quality.Model(*model.parts())
    assert all(again.score(t) == model.score(t) for t in (None, "", "some words", "x" * 5000))
