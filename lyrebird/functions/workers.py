"""How Python workers get this package: as a zip that Spark hands to every executor."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


@functools.lru_cache(maxsize=1)
def _package_zip() -> str:
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="lyrebird-src-")) / "lyrebird.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return str(out)


def ship(spark: SparkSession) -> None:
    """Once a session; workers then import the package's functions rather than unpickle copies of them."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_package_zip())
        _shipped.add(app)
