import builtins

import __spark_entry__


def test_every_query_has_sql():
    queries, sql = __spark_entry__._core()
    assert set(queries) == set(sql) and len(queries) >= 65


def test_core_stands_without_the_other_subpackage(monkeypatch, recwarn):
    real = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("ledgerloom.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", refuse)
    assert set(__spark_entry__.queries()) == set(__spark_entry__._core()[0]) and recwarn
