"""DataFrame operators: normalisers, deduplication, storage, quality, coverage, pages."""
