from .export import export_csv, export_schema
from .ingest import USUAL_NULLS, ingest, nulls_for, read_csv_feed
from .readers import feed_path, read_feed, read_file
from .schemas import FEEDS, Feed

__all__ = [
    "FEEDS",
    "Feed",
    "USUAL_NULLS",
    "export_csv",
    "export_schema",
    "feed_path",
    "ingest",
    "nulls_for",
    "read_csv_feed",
    "read_feed",
    "read_file",
]
