"""The registered queries, by area; importing a module registers its queries."""

from granary.catalog import checks, evaluation, ingest, records, retrieval, storage, streams, traces  # noqa: F401
