"""The registry that query modules fill: callables by name, and the same queries as SQL where SQL can say them."""

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add
