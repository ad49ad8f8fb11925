"""The command line lists the catalogue and runs a query."""

from conftest import SF_SMALL
from emporion.__main__ import main


def test_list_queries(capsys):
    assert main([]) == 0
    out = capsys.readouterr().out
    assert "e2_delay_by_category" in out and "h13_model_comparison" in out


def test_run_query(spark, capsys):
    assert main(["e11_kpis", SF_SMALL, "--rows", "1"]) == 0
    assert "total_orders" in capsys.readouterr().out


def test_unknown_query(capsys):
    assert main(["no_such_query"]) == 2
