"""The rest of the library stands without the llm folders."""

import subprocess
import sys
from pathlib import Path


def test_entry_point_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in ["__spark_entry__.py", *(str(x.relative_to(root)) for x in (root / "lyrebird").rglob("*.py") if "llm" not in x.parts)]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text((root / p).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') for x in q); print(len(e.oracle_sql()))"
    for x in [*(root / "tests").glob("*.py"), root / "pytest.ini"]:
        (tmp_path / x.relative_to(root)).parent.mkdir(exist_ok=True)
        (tmp_path / x.relative_to(root)).write_text(x.read_text())
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", *args], cwd=tmp_path, capture_output=True, text=True)
    assert run("--collect-only").returncode == 0 and run("tests/test_tracks.py").returncode == 0
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}).stdout) > 50
