"""Decorator that registers a query with its DuckDB form."""


def registrar(queries: dict, oracles: dict):
    def query(oracle: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return put

    return query
