"""All registered queries and their check SQL."""

from aeromosaic.plans import (
    enhance_queries,
    failure_queries,
    feature_queries,
    match_queries,
    mosaic_queries,
    transform_queries,
)

_PARTS = [mosaic_queries, feature_queries, match_queries, transform_queries, enhance_queries, failure_queries]

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
