import pytest

from quillspan.plans.timing import Stages


def test_stages_add_up_even_after_errors():
    t = Stages()
    for _ in range(2):
        with t.stage("a"):
            pass
    with pytest.raises(ValueError), t.stage("b"):
        raise ValueError
    assert set(t.ms) == {"a", "b"} and t.total_ms == sum(t.ms.values())
