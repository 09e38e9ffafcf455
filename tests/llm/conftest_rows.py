"""The odd documents as plain (id, text) pairs."""

import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_mod = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_mod)
ODD = [(r[0], r[1]) for r in _mod.odd_rows()]
prose = _mod.prose
