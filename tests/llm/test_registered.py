"""All corpus operators are registered wherever they are installed."""

import __spark_entry__ as entry
import corpus_pipeline


def test_every_operator_has_its_query():
    numbers = {int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op") and name[2].isdigit()}
    assert numbers == set(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
