"""All registered queries, by family."""

from dialwise.catalog import base
from dialwise.catalog import (  # noqa: F401
    profile, features, groups, ranking, encode, rebalance, models, folds)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
