"""Readers, sinks and the test-data fixtures."""
from .files import (scan_csv, scan_first_existing, scan_json_lookup, scratch_path,  # noqa: F401
                    sink_csv, sink_json, sink_parquet)
