"""All registered queries of the core and their SQL."""

from arborlake import nested_queries, oracle, queries

QUERIES: dict = {**queries.QUERIES, **nested_queries.QUERIES}
SQL: dict = {**oracle.build(), **nested_queries.SQL}
