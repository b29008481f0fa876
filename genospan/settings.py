"""Engine settings, kept in the Spark session's configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PREFIX = "spark.genospan."
DEFAULTS: dict[str, object] = {
    "max_matrix_elements": 16 * 1024**3,
    "max_threads": 0,
    "use_parquet_companions": True,
    "matrix_io": "auto",
    "localize_dir": "",
    "sample_counts_sparse": False,
    "search_path": "",
}
_IO = ("auto", "native", "vfs", "localize")


def set_setting(spark: SparkSession, name: str, value) -> None:
    """Set an engine setting; unknown names and values out of range are errors."""
    if name not in DEFAULTS:
        raise ValueError(f"unknown setting '{name}'")
    if name == "max_matrix_elements" and int(value) <= 0:
        raise ValueError("max_matrix_elements must be > 0")
    if name == "max_threads" and int(value) < 0:
        raise ValueError("max_threads must be >= 0")
    if name == "matrix_io" and value not in _IO:
        raise ValueError(f"matrix_io must be one of {', '.join(_IO)}")
    spark.conf.set(_PREFIX + name, str(value).lower() if isinstance(value, bool) else str(value))


def setting(spark: SparkSession, name: str):
    default = DEFAULTS[name]
    raw = spark.conf.get(_PREFIX + name, None)
    if raw is None:
        return default
    if isinstance(default, bool):
        return raw == "true"
    return int(raw) if isinstance(default, int) else raw
