"""The library's registered queries, and their SQL."""

from quirelab.plans import block_queries, content_queries, detail_queries, display_queries, page_queries, text_queries

QUERIES = {**page_queries.QUERIES, **text_queries.QUERIES, **detail_queries.QUERIES, **block_queries.QUERIES, **display_queries.QUERIES, **content_queries.QUERIES}
ORACLE_SQL = {**page_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **detail_queries.ORACLE_SQL, **block_queries.ORACLE_SQL, **display_queries.ORACLE_SQL, **content_queries.ORACLE_SQL}
