"""All queries of the library's own operators by name, and their SQL."""

from cuewright.plans import catalogue_queries, library_queries, stream_queries, text_queries, timeline_queries

_ALL = timeline_queries.QUERIES | text_queries.QUERIES | catalogue_queries.QUERIES | library_queries.QUERIES | stream_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
