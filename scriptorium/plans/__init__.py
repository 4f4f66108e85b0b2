"""Queries over the driver's tables, module by module."""

from scriptorium.plans import catalogue, knowledge_queries, markup_queries, source_queries, status_queries, stream_queries, wiki_queries

MODULES = (catalogue, knowledge_queries, markup_queries, source_queries, status_queries, stream_queries, wiki_queries)
