from cellmob.sources.readers import FILE_PATTERN, read_events, read_events_parquet
from cellmob.sources.writers import write_csv, write_json

__all__ = ["FILE_PATTERN", "read_events", "read_events_parquet", "write_csv", "write_json"]
