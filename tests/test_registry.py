import __spark_entry__ as e


def test_registry_is_not_empty():
    assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_llm():
    from pathlib import Path

    for f in Path(e.__file__).parent.joinpath("codelens").rglob("*.py"):
        if "llm" not in f.parts:
            assert "codelens.llm" not in f.read_text(), f
