import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 30


def test_rest_works_without_the_training_data_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['headlight.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'lexical_score' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
