"""All queries of the library and, where SQL can express them, their DuckDB equivalents."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under name, with its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return add


from lumenfold.plans import control_queries, library_queries, source_queries, stat_queries, unmix_queries  # noqa: E402, F401
