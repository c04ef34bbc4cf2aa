"""Command line: minify a file, standard input, or a folder of Markdown files; `eval` and `bench` report on folders."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .config import CodeMode, Config, GrammarLevel, Level
from .functions.lexicon import THRESHOLDS
from .operators.minify import minify_text
from .sources.corpus import stats_line


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillpress", description="Shrink Markdown for use as model context.")
    p.add_argument("file", nargs="?", help="file or folder; standard input if absent")
    p.add_argument("-l", "--level", help="0-4, off, light, medium, structured, ultra (default: QUILLPRESS_LEVEL or medium)")
    p.add_argument("-c", "--code-blocks", help="preserve, compress-whitespace or compress")
    p.add_argument("-o", "--output", help="file to write, or folder for a folder")
    p.add_argument("-s", "--stats", action="store_true", help="token counts on standard error")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--no-legend", action="store_true")
    p.add_argument("-g", "--grammar", nargs="?", const="medium", help="drop filler words: light, medium or aggressive")
    p.add_argument("-d", "--dictionary", action="store_true")
    return p


def config_of(args: argparse.Namespace) -> Config:
    config = Config.from_env()
    if args.level is not None:
        config = config.with_level(Level.parse(args.level))
    if args.code_blocks is not None:
        config = config.with_code_blocks(CodeMode.parse(args.code_blocks))
    if args.grammar is not None:
        config = config.with_grammar_strip(GrammarLevel.parse(args.grammar))
    return config.with_legend(not args.no_legend).with_dictionary(args.dictionary)


def run(args: argparse.Namespace) -> None:
    config = config_of(args)
    if args.file and os.path.isdir(args.file):
        return _run_folder(args, config)
    if args.file:
        try:
            with open(args.file, encoding="utf-8", newline="") as f:
                text = f.read()
        except (OSError, UnicodeDecodeError) as e:
            raise ValueError(f"reading {args.file!r}: {e}") from e
    else:
        text = sys.stdin.read()
    out = minify_text(text, config)
    if args.output:
        with open(args.output, "w", encoding="utf-8", newline="") as f:
            f.write(out)
    else:
        sys.stdout.write(out)
    if args.stats and not args.quiet:
        before, after = len(text.encode()) // 4, len(out.encode()) // 4
        print(stats_line(before, after, max(before - after, 0) / before * 100 if before else 0.0), file=sys.stderr)


def _run_folder(args: argparse.Namespace, config: Config) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.minify import minify
    from .sources.corpus import read_markdown, write

    if not args.output:
        raise ValueError("a folder needs --output")
    spark = SparkSession.builder.appName("quillpress").getOrCreate()
    write(minify(read_markdown(spark, args.file), config=config).drop("text"), args.output)
    if args.stats and not args.quiet:
        row = spark.read.parquet(args.output).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))).first()
        print(stats_line(row[0], row[1], max(row[0] - row[1], 0) / row[0] * 100 if row[0] else 0.0), file=sys.stderr)


def _eval_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillpress eval", description="Check how much of a folder's content its minified texts still hold.")
    p.add_argument("folder")
    p.add_argument("--sample", type=int, default=10, help="files, by the hash of their path (default: 10)")
    p.add_argument("--all", action="store_true", help="all files")
    p.add_argument("--level", default="2")
    p.add_argument("--no-grammar", action="store_true")
    p.add_argument("--no-dict", action="store_true")
    p.add_argument("--noise-floor", action="store_true", help="check the texts against themselves")
    p.add_argument("--output", help="JSON report to write")
    p.add_argument("--rows", help="folder for a JSON line per file")
    p.add_argument("--check", action="store_true", help="exit 1 unless every file passes")
    return p


def _eval(argv: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import recall
    from .operators.minify import minify_output
    from .operators.spread import spread
    from .sources import corpus

    args = _eval_parser().parse_args(argv)
    config = Config(Level.parse(args.level)).with_dictionary(not args.no_dict)
    if not args.no_grammar:
        config = config.with_grammar_strip()
    spark = SparkSession.builder.appName("quillpress eval").getOrCreate()
    docs = corpus.long_enough(corpus.read_markdown(spark, args.folder))
    docs = corpus.shortened(spread(docs if args.all else corpus.sample(docs, args.sample)))
    checked = recall.evaluate(docs.withColumn("output", F.col("text") if args.noise_floor else minify_output(F.col("text"), config))).drop("text", "output")
    if args.rows:
        corpus.write_json_report(checked, args.rows)
    total = recall.summary(checked).first().asDict()
    passed = total["n_docs"] == total["n_pass"]
    print("\n".join(f"{k}: {v}" for k, v in total.items()))
    print("passed" if passed else "failed")
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            json.dump({"mode": "noise_floor" if args.noise_floor else "evaluation", "overall_pass": passed, "thresholds": THRESHOLDS, "summary": total}, f, indent=2)
    return int(args.check and not passed)


def _bench(argv: list[str]) -> int:
    import tempfile
    import time

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.spread import spread
    from .plans import suites
    from .sources import corpus

    p = argparse.ArgumentParser(prog="quillpress bench", description="Run all settings over folders and report savings, structure and reversibility.")
    p.add_argument("folders", nargs="+")
    p.add_argument("--json", action="store_true")
    p.add_argument("--runs", help="folder for the outputs of all settings, which all workers reach (default: a temporary one)")
    args = p.parse_args(argv)
    spark, began = SparkSession.builder.appName("quillpress bench").getOrCreate(), time.perf_counter()
    docs = spread(corpus.long_enough(corpus.read_markdown(spark, *args.folders))).withColumnRenamed("path", "doc_id")
    with tempfile.TemporaryDirectory() as own:
        if not args.runs and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster bench needs --runs, a folder that all workers reach")
        place = args.runs or "file://" + own + "/runs"
        corpus.write(suites.run_grid(docs), place)
        found = suites.report(spark.read.parquet(place), docs)
    size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    found = {"corpus": {"files": size[0], "bytes": size[1]}, "duration_ms": int((time.perf_counter() - began) * 1000)} | found
    sys.stdout.write(suites.as_json(found) + "\n" if args.json else f"Corpus: {size[0]} files, {size[1]} bytes, {found['duration_ms']} ms\n" + suites.as_text(found))
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        if argv[:1] == ["eval"] and not os.path.exists("eval"):
            return _eval(argv[1:])
        if argv[:1] == ["bench"] and not os.path.exists("bench"):
            return _bench(argv[1:])
        run(parser().parse_args(argv))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
