import __spark_entry__ as e


def test_every_problem_has_its_query():
    names = set(e.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} <= names
    assert any(n.startswith("p8_") for n in names)
    assert "p2_found" in e.oracle_sql()
