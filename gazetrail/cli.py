"""Command line: python -m gazetrail.cli STEP --flags."""

from __future__ import annotations

import argparse
import importlib.util

from pyspark.sql import functions as F

from gazetrail import session
from gazetrail.operators import joins, scoring
from gazetrail.plans import analysis, corpus
from gazetrail.schema import with_order
from gazetrail.sources import tables, xlsx


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gazetrail")
    steps = p.add_subparsers(dest="step", required=True)

    def step(name: str, *flags: str, **more: dict) -> None:
        s = steps.add_parser(name)
        for f in flags:
            s.add_argument(f"--{f}", required=True)
        for f, options in more.items():
            s.add_argument(f"--{f.replace('_', '-')}", **options)

    step("inspect", "input", sheet={"default": "0"}, rows={"type": int, "default": 5})
    step("convert", "input", "output", sheet={"default": "DATA"}, chunk_size={"type": int, "default": 50_000})
    step("prepare-corpus", "config", "input", "output", zipf={}, grain={"default": "item", "choices": ["item", "row"]})
    step("prepare-trials", "input", "out-dir", zipf={})
    step("ngram", "input", "output", train_text={}, order={"type": int, "default": 5}, alpha={"type": float, "default": 0.1}, min_count={"type": int, "default": 1})
    step("surprisal-ar", "input", "output", model={"default": "distilgpt2"}, device={}, max_sentences={"type": int})
    step("surprisal-mlm", "input", "output", model={"default": "roberta-base"}, device={}, max_sentences={"type": int}, max_length={"type": int, "default": 512})
    step("merge", "base", "output", feature={"action": "append", "required": True})
    step("analyse", "input", "output-dir", targets={"nargs": "+", "default": analysis.TARGETS})
    step("plots", "results-dir", "output-dir")
    return p


def _report(spark, path: str, columns: list[str] | None = None) -> None:
    """How many rows were written, counted from the written files."""
    print(f"{path}: {tables.read(spark, path).count():,} rows" + (f", {len(columns)} columns" if columns else ""))


def _scorer(name: str, masked: bool, device: str | None, max_length: int, scorers: dict):
    """A factory of scorers: one that is given, the stand-in under its own name only, or a pretrained model."""
    if name in scorers:
        return scorers[name]
    if name == "stand-in":
        model = lambda: scoring.StandIn(masked)
    elif all(map(importlib.util.find_spec, ("torch", "transformers"))):
        model = lambda: scoring.Pretrained(name, masked, device)
    else:
        raise SystemExit(f"no scorer for the model {name}: torch and transformers are not installed; pass one to main(scorers=...), or --model stand-in for made-up scores")
    return lambda: scoring.Masked(model(), max_length) if masked else scoring.Causal(model())


def main(argv: list[str] | None = None, scorers: dict | None = None) -> None:
    """`scorers` maps a model's name to a factory of a scorer; the deterministic stand-in scores only under its own name."""
    a = parser().parse_args(argv)
    spark = session.local()
    read = lambda path: tables.read(spark, path)
    ordered = lambda df: df if "_row_ord" in df.columns else with_order(df)
    zipf = read(a.zipf) if getattr(a, "zipf", None) else None
    if a.step == "inspect":
        if tables.suffix(a.input) in (".xlsx", ".xlsm"):
            print("sheets:", [n for n, _ in xlsx.sheets(a.input)])
        names, head = tables.inspect(tables.read(spark, a.input, sheet=a.sheet), a.rows)
        for i, n in names:
            print(i, n)
        head.show(a.rows, truncate=False)
    elif a.step == "convert":
        print("written" if tables.ingest(spark, a.input, a.output, a.sheet, a.chunk_size) else "no rows")
    elif a.step == "prepare-corpus":
        out = corpus.standard(ordered(read(a.input)), corpus.load_config(a.config), zipf, a.grain)
        tables.write(corpus.sorted_standard(out), a.output)
        _report(spark, a.output)
    elif a.step == "prepare-trials":
        corpus.write_trials(corpus.trials(ordered(read(a.input)), zipf), a.out_dir)
        for name in ("clean_wordlevel", "items", "sentences"):
            _report(spark, f"{a.out_dir}/{name}.parquet")
    elif a.step == "ngram":
        train = tables.text_lines(spark, a.train_text) if a.train_text else None
        tables.write(corpus.ngram_table(ordered(read(a.input)), train, a.order, a.alpha, a.min_count), a.output)
    elif a.step in ("surprisal-ar", "surprisal-mlm"):
        masked = a.step == "surprisal-mlm"
        suffix = "pseudo_surprisal" if masked else "surprisal"
        factory = _scorer(a.model, masked, a.device, a.max_length if masked else 0, scorers or {})
        tables.write(scoring.model_surprisal(ordered(read(a.input)), factory, a.model, suffix, a.max_sentences), a.output)
    elif a.step == "merge":
        out = joins.merge_features(read(a.base), *map(read, a.feature))
        tables.write(out, a.output)
        _report(spark, a.output, out.columns)
    elif a.step == "analyse":
        _, skipped = analysis.analyse(read(a.input), a.targets, a.output_dir)
        for t in skipped:
            print("not in the table:", t)
    elif a.step == "plots":
        results = tables.result_files(spark, a.results_dir)
        for value in ("delta_r2_vs_lexical", "cv_rmse"):
            tables.write(analysis.chart(results, value).coalesce(1), f"{a.output_dir}/{value}.csv")
        tables.write(analysis.pivot(results.withColumn("r2", F.col("r2").cast("double"))).coalesce(1), f"{a.output_dir}/r2.csv")


if __name__ == "__main__":
    main()
