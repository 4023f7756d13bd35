import os

from pairweave import session


def folders(names):
    return [os.path.exists(n.partition(":")[2] or n) for n in names]


def test_work_tables_have_an_owner(spark):
    before = set(session._OWNED)
    one, two = (session.materialize(spark.range(5), "t") for _ in range(2))
    made = sorted(set(session._OWNED) - before)
    assert len(made) == 2 and folders(made) == [True, True] and one.count() == 5
    session.discard(one)
    assert sorted(folders(made)) == [False, True] and two.count() == 5
    session.discard(*made)
    assert folders(made) == [False, False] and set(session._OWNED) == before
    session.discard("/no/such/table")


def test_work_scope_keeps_what_it_is_told(spark):
    before = set(session._OWNED)
    with session.work_scope() as keep:
        session.materialize(spark.range(3), "on-the-way")
        result = keep(session.materialize(spark.range(4).repartition(2), "result"))
        made = sorted(set(session._OWNED) - before)
    assert result.count() == 4
    assert sorted(folders(made)) == [False, True]
    session.discard(result)
    assert set(session._OWNED) == before
