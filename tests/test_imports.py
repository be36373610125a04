"""Every module can be the first to be imported."""

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).parents[1]
MODULES = sorted(".".join(p.relative_to(ROOT).with_suffix("").parts).removesuffix(".__init__") for p in (ROOT / "blockloom").rglob("*.py") if "llm" not in p.parts)


@pytest.mark.parametrize("module", [m for m in MODULES if m.split(".")[1:2] in (["plans"], ["sources"], ["streaming"])])
def test_import_first(module):
    subprocess.run([sys.executable, "-c", f"import {module}; from blockloom.plans.registry import QUERIES; import blockloom.plans; assert len(QUERIES) > 100"], cwd=ROOT, check=True, timeout=60)
