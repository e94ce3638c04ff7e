"""The grading pipeline from the command line: one subcommand a process, from photos to a model."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import explain, features, metrics, outliers, sampling
from .operators.checks import assert_clean
from .operators.folds import with_folds
from .plans import training
from .schema import ID, MODELS, ORIGINAL, TRANSFORMS, Settings
from .sources.artifact import save_artifact
from .sources.images import read_images, require_images, with_images, write_masks
from .sources.manifest import exclude, load_exclusions, load_manifest, read_table, write_table
from .sources.settings import load_settings, read_report, write_report


@dataclass(frozen=True)
class Run:
    """What a process works with."""

    spark: SparkSession
    given: argparse.Namespace
    settings: Settings

    def at(self, name: str) -> str:
        return f"{self.given.out}/{name}"

    def place(self, name: str) -> str:
        """A table's, which tells its format."""
        return self.at(name) + (".csv" if self.given.format == "csv" else "")

    def table(self, name: str):
        return read_table(self.spark, self.place(name))

    def write(self, df, name: str) -> None:
        write_table(df, self.place(name), self.given.format == "csv")

    def report(self, content: dict, name: str) -> None:
        write_report(content, self.at(f"results/{name}.json"))

    def images(self, rows):
        """rows with their photos, all of which must be there."""
        root = self.given.csv.rpartition("/")[0] or "."
        return require_images(with_images(rows, read_images(self.spark, f"{root}/{self.given.photos}"), root))

    def balanced(self):
        """(photos kept, batches dropped) of the checked list."""
        g, s = self.given, self.settings
        manifest, _ = exclude(assert_clean(load_manifest(self.spark, g.csv)), load_exclusions(self.spark, g.exclusions) if g.exclusions else None)
        return sampling.balance(manifest, s.min_grade_ratio, s.balance_seed)

    @property
    def trials(self) -> int:
        return self.given.n_trials or self.settings.n_trials


def mask(run: Run) -> None:
    """masks of all photos, as pictures and as shares of the frame"""
    manifest = load_manifest(run.spark, run.given.csv)
    rows = manifest.orderBy(ID).limit(run.given.limit) if run.given.limit else manifest
    found = write_masks(run.images(rows), run.at("masks"), run.settings, run.given.preview)
    run.write(found, "mask_summary")
    found = run.table("mask_summary")
    found.agg(F.min("mask_fraction"), F.median("mask_fraction"), F.max("mask_fraction")).show()
    found.filter("mask_fraction < 0.05 or mask_fraction > 0.5").orderBy(ID).show(50)


def extract(run: Run) -> None:
    """photo list and photos to a feature table"""
    rows, dropped = run.balanced()
    write_table(dropped, run.at("balance_dropped.csv"), csv=True)
    run.write(features.feature_rows(run.images(rows), run.settings, (ORIGINAL,) if run.given.no_augment else TRANSFORMS), "feature_rows")
    every = run.table("feature_rows")
    run.write(every.filter("error is null").drop("error"), "features")
    every.filter("error is not null").select(ID, "error").show(50, truncate=False)


def folds(run: Run) -> None:
    """outlier removal, folds"""
    kept, flagged = outliers.remove_outlier_photos(run.table("features"), run.settings)
    outliers.most_flagged(flagged).show()
    run.write(kept, "features_clean")
    dealt = with_folds(run.table("features_clean"), run.settings).filter(F.col("augment") == ORIGINAL)
    run.write(dealt.select(ID, "batch_id", "class", "fold").orderBy("fold", ID), "folds")


def train(run: Run) -> None:
    """nested cross-validation, selection, pass marks"""
    found = training.cross_validate(run.table("features_clean"), run.settings, tuple(run.given.models), run.trials)
    for name in ("scores", "params", "predictions"):
        run.write(getattr(found, name), f"results/{name}")
    scores, preds = run.table("results/scores"), run.table("results/predictions")
    metrics.score_summary(scores).orderBy("model").show()
    best: dict[str, dict] = {}
    for r in found.params.orderBy("model", "fold").collect():  # a row a model and fold
        best.setdefault(r.model, {})[str(r.fold)] = dict(r.params)
    run.report(best, "best_params")
    run.report({name: _measures(preds.filter(F.col("model") == name)) for name in run.given.models}, "metrics")
    selected = metrics.select_model(scores)
    run.report({"selected": selected}, "selection")
    marks = metrics.pass_marks(preds, scores, selected, run.settings.marks)
    run.report({"selected": selected, "checks": [r.asDict() for r in marks.collect()], "all_passed": metrics.all_passed(marks).first()[0]}, "pass_marks")


def _measures(own) -> dict:
    labels, matrix = metrics.ordered_matrix(metrics.confusion_cells(own))
    per_class = {r["class"]: {"precision": r.precision, "recall": r.recall, "support": r.support} for r in metrics.class_metrics(own).collect()}
    return {"labels": labels, "confusion_matrix": matrix, "accuracy": metrics.accuracy(own).first()[0], "macro_f1": metrics.macro_f1(own).first()[0], "per_class": per_class}


def quick_train(run: Run) -> None:
    """the same with three trials a model, unless told otherwise"""
    run.given.n_trials = run.given.n_trials or 3
    train(run)


def deploy(run: Run) -> None:
    """the selected model on all data, saved, with its importances"""
    selected, table = read_report(run.at("results/selection.json"))["selected"], run.table("features_clean")
    model, params = training.fit_final(table, run.settings, selected, run.trials)
    save_artifact(model, run.settings, run.at("model"), params, {"date": time.strftime("%Y-%m-%d")})
    values = explain.shapley_values(model, training.originals(table))
    shares = metrics.family_shares(explain.importance_by_family(values), []).orderBy(F.desc("share"))
    run.report({r.family: r.value for r in shares.collect()}, "shap_by_family")


def lighting(run: Run) -> None:
    """whether the background alone gives the class away"""
    photos, report = run.images(run.balanced()[0]), {}
    for name, reference in (("raw", None), ("normalized", run.settings.reference_grey)):
        run.write(features.paper_table(photos, reference), f"paper_{name}")
        report[name] = training.paper_accuracy(run.table(f"paper_{name}"), run.settings).first().asDict()
    run.report(report, "lighting_check")


def ablation(run: Run) -> None:
    """each feature family alone against all"""
    all_models = run.given.models == list(MODELS)
    names = (read_report(run.at("results/selection.json"))["selected"],) if all_models else tuple(run.given.models)
    rows, report = training.ablation(run.table("features_clean"), run.table("results/scores"), run.settings, names, run.trials)
    run.write(rows, "results/ablation_scores")
    run.report({r.model: r.asDict() for r in report.collect()}, "ablation")


PROCESSES: dict[str, Callable[[Run], None]] = {"mask": mask, "features": extract, "folds": folds, "train": train, "quick-train": quick_train, "deploy": deploy, "lighting": lighting, "ablation": ablation}
#: What "all" goes through.
ALL = ("features", "folds", "train", "deploy")


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config", help="settings as YAML")
    common.add_argument("--csv", default="dataset/photos.csv", help="photo list")
    common.add_argument("--photos", default="photos", help="folder of photos beside the list")
    common.add_argument("--exclusions", help="CSV of photo ids to leave out")
    common.add_argument("--out", default="data")
    common.add_argument("--format", choices=("parquet", "csv"), default="parquet", help="of the tables between processes")
    common.add_argument("--models", nargs="+", default=list(MODELS), choices=MODELS)
    common.add_argument("--n-trials", type=int)
    common.add_argument("--limit", type=int, help="photos to mask, the first by id")
    common.add_argument("--preview", type=int, default=0, help="photos on the sheet of outlines")
    common.add_argument("--no-augment", action="store_true")
    top = argparse.ArgumentParser(prog="sievework", description=__doc__)
    names = top.add_subparsers(dest="process", metavar="process")
    for name, process in PROCESSES.items():
        names.add_parser(name, parents=[common], help=process.__doc__)
    names.add_parser("all", parents=[common], help=", ".join(ALL))
    return top


def chosen(ask: Callable[[str], str] = input) -> str | None:
    """A process asked for by name, or by its number in the list; None if none is wanted."""
    listed = dict(enumerate([*PROCESSES, "all"], 1))
    print(*(f"{number}: {name}" for number, name in listed.items()), sep="\n")
    valid = {str(number): name for number, name in listed.items()} | {name: name for name in listed.values()}
    while answer := ask("which? (nothing to leave) ").strip().lower():
        if answer in valid:
            return valid[answer]
    return None


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(f"sievework {name}").config("spark.sql.execution.arrow.maxRecordsPerBatch", "16").getOrCreate()


def go(given: argparse.Namespace, spark: SparkSession) -> None:
    """The process that was asked for, or all of them in order, in this session; an error ends them."""
    settings = load_settings(given.config) if given.config and Path(given.config).exists() else Settings()
    for name in ALL if given.process == "all" else (given.process,):
        began = time.monotonic()
        PROCESSES[name](Run(spark, given, settings))
        print(f"{name} took {time.monotonic() - began:.0f} s", flush=True)


def main(argv: list[str], ask: Callable[[str], str] = input, start: Callable[[str], SparkSession] = session) -> int:
    """0, or 1 where a process failed, or 2 (from the parser) for what it does not know."""
    if not argv:
        name = chosen(ask)
        if name is None:
            return 0
        argv = [name]
    given = parser().parse_args(argv)
    try:
        go(given, start(given.process))
    except (ValueError, KeyError, FileNotFoundError) as error:
        print(f"sievework: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
