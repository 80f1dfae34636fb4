"""The queries by area; importing this package fills the catalogue."""

from riskloom.plans import datasets, drafts, evaluation, factsheets, quality, ratings, retrieval, selection, sources, streams, text  # noqa: F401
