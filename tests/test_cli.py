import argparse

import pytest

from sievework import cli
from sievework.schema import DatasetError


@pytest.fixture
def ran(monkeypatch):
    seen = []

    def put(name, fails=None):
        def process(run):
            seen.append((name, run.given.n_trials))
            if fails:
                raise fails
        monkeypatch.setitem(cli.PROCESSES, name, process)

    for name in cli.PROCESSES:
        put(name)
    seen_and_put = argparse.Namespace(seen=seen, put=put)
    return seen_and_put


def start(_):
    return None


def test_all_runs_in_order(ran):
    assert cli.main(["all", "--n-trials", "2"], start=start) == 0
    assert [name for name, _ in ran.seen] == ["features", "folds", "train", "deploy"] and ran.seen[2][1] == 2


def test_all_stops_at_the_first_failure(ran, capsys):
    ran.put("folds", DatasetError("a bad batch"))
    assert cli.main(["all"], start=start) == 1
    assert [name for name, _ in ran.seen] == ["features", "folds"] and "a bad batch" in capsys.readouterr().err


def test_quick_train_has_three_trials(monkeypatch):
    seen = []
    monkeypatch.setattr(cli, "train", lambda run: seen.append(run.given.n_trials))
    for argv in (["quick-train"], ["quick-train", "--n-trials", "5"]):
        cli.main(argv, start=start)
    assert seen == [3, 5]


def test_unknown_processes_and_help_end(capsys):
    for argv, code in ((["nothing"], 2), (["--help"], 0)):
        with pytest.raises(SystemExit) as end:
            cli.main(argv, start=start)
        assert end.value.code == code
    assert "ablation" in capsys.readouterr().out


def test_processes_are_chosen_by_number_or_name(ran):
    answers = iter(["99", "4"])
    assert cli.chosen(lambda _: next(answers)) == "train"
    assert cli.chosen(lambda _: "") is None and cli.chosen(lambda _: "ALL") == "all"
    assert cli.main([], ask=lambda _: "") == 0 and cli.main([], ask=lambda _: "mask", start=start) == 0
    assert ran.seen == [("mask", None)]


def test_arguments():
    given = cli.parser().parse_args(["train", "--models", "xgboost", "--limit", "3"])
    assert given.models == ["xgboost"] and given.limit == 3 and given.out == "data"
