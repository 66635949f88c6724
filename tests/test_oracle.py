"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from checks.registry import PAIRS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(PAIRS))
def test_same_rows(spark, con, key):
    assert differences(spark, con, SF, key) is None


def test_contract(spark):
    assert set(PAIRS) <= set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.columns == ["vehicle_no", "monthly_total"] and df.count() > 0


def test_parts_may_be_missing(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "needs_gone.py").write_text("import gone_part")
    (tmp_path / "is_broken.py").write_text("import something_else_gone")
    assert contract._optional("gone_part") is None
    assert contract._optional("needs_gone", "gone_part") is None
    with pytest.raises(ModuleNotFoundError):
        contract._optional("is_broken", "gone_part")
