from .pipeline import LAYER_DATABASES, PUBLISHED, TABLES, Lazy, build, edges, open_feeds
from .reports import customers_per_state, seller_classification
from .staging import STAGING, stage

__all__ = [
    "LAYER_DATABASES",
    "PUBLISHED",
    "STAGING",
    "TABLES",
    "Lazy",
    "build",
    "customers_per_state",
    "edges",
    "open_feeds",
    "seller_classification",
    "stage",
]
