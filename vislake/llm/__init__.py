"""Training-data operators on texts, percentiles and nearest times; nothing outside this folder imports them."""

#: Modules of this folder with QUERIES and ORACLE.
QUERY_MODULES: list[str] = ["rank_queries", "nearest_queries", "text_queries", "residue_queries"]
