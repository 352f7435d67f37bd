"""The registered queries of this subpackage and their check SQL."""

from aeromosaic.llm import (
    conversations,
    decontaminate,
    language,
    license_scan,
    mixing,
    neighbours,
    packing,
    ppm,
    secret_scan,
    sharding,
    simhash,
    spelling,
    token_counts,
)

_PARTS = [
    neighbours,
    secret_scan,
    token_counts,
    sharding,
    decontaminate,
    license_scan,
    simhash,
    mixing,
    language,
    ppm,
    packing,
    conversations,
    spelling,
]

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
