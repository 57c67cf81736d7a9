"""Fixed facts of the data model: databases, their order and priority, unified columns."""

from __future__ import annotations

# Processing order of the databases, and their priority when a representative is picked.
DB_ORDER = ["pubmed", "scopus", "semantic_scholar", "biorxiv_medrxiv", "springernature", "arxiv", "google_scholar"]
DB_PRIORITY = {db: k for k, db in enumerate(DB_ORDER, 1)}
OTHER_PRIORITY = 99
#: An abstract counts as present if it is longer than this after stripping.
MIN_ABSTRACT = 10

UNIFIED = [
    "source_db", "title_original", "title_normalized", "doi_original", "doi_normalized", "pmid", "arxiv_id_original", "arxiv_id_normalized",
    "s2_id", "abstract", "authors", "year", "venue", "date", "url", "scopus_id", "epmc_id",
]
