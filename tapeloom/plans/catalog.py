"""All queries of the engine: name -> (function of (spark, sf_dir), DuckDB text or None)."""

from tapeloom.plans import book_queries, data_queries, model_queries, order_queries

CATALOG = {**book_queries.CATALOG, **order_queries.CATALOG, **data_queries.CATALOG, **model_queries.CATALOG}
