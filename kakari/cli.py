"""Command lines: parse, learn, index, evaluate. python -m kakari.cli parse -f1 FILE ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kakari import api
from kakari.operators import evaluate, model
from kakari.operators.train import train_links
from kakari.plans.pipeline import Parser
from kakari.sources.config import options_from
from kakari.sources.layers import read_blocks, read_layer
from kakari.sources.models import load_model, open_model, save_compiled, save_model, write_text_model


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parse(argv: list[str]) -> int:
    """Parses files, to text files in the folder given by -o or to the standard output; - reads the standard input."""
    options, inputs = options_from(argv)
    spark = session()
    if inputs in ([], ["-"]):
        rows = spark.createDataFrame([(i, s.rstrip("\n")) for i, s in enumerate(sys.stdin)], "line long, sentence string")
    else:
        rows = api.read(spark, inputs, options.input_layer, options.charset)
    link = open_model(spark, options.parser_model, options.posset) if options.parser_model else None
    parser = Parser(options.posset, options.ne, link=link)
    out = parser.parse_to_text(rows, options.output_format, options.input_layer, options.output_layer)
    if options.output:
        out.select(F.regexp_replace("text", "\n$", "").alias("value")).write.text(options.output)
    else:
        for row in out.select("text").toLocalIterator():
            sys.stdout.write(row.text)
    return 0


def learn(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="kakari learn")
    p.add_argument("corpus")
    p.add_argument("model")
    p.add_argument("-c", "--cost", type=float, default=0.0015)
    p.add_argument("-f", "--freq", type=int, default=1)
    p.add_argument("-P", "--posset", default="IPA")
    p.add_argument("-M", "--old-model")
    p.add_argument("--text", action="store_true", help="also write the text form, beside the tables")
    a = p.parse_args(argv)
    spark = session()
    old = load_model(spark, a.old_model)[1:] if a.old_model else None
    params, dic, sv, stats = train_links(read_layer(read_blocks(spark, a.corpus), 2, mode="FAILFAST"), "path", "block", cost=a.cost, freq=a.freq, tags=a.posset, previous=old)
    save_model(a.model, params, dic, sv)
    if a.text:
        write_text_model(f"{a.model}/text", params, dic, sv)
    print(f"Error: {stats.errors}\nL1 Loss: {stats.loss}\nBSV: {stats.bounded}\nSV: {stats.support}\nobj: {stats.objective}")
    return 0


def index(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="kakari index")
    p.add_argument("model")
    p.add_argument("compiled")
    p.add_argument("-s", "--sigma", type=float, default=0.0001)
    p.add_argument("-n", "--minsup", type=int, default=2)
    p.add_argument("-F", "--freq-feature-size", type=int, default=3000)
    a = p.parse_args(argv)
    _, _, sv = load_model(session(), a.model)
    pairs = model.prune_pairs(model.expand_pairs(sv), sv, a.sigma, a.minsup, a.freq_feature_size)
    save_compiled(a.compiled, *model.quantise(model.expand_bias(sv), model.expand_singles(sv), pairs))
    return 0


def evaluation(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="kakari eval")
    p.add_argument("-e", "--mode", default="dep", choices=["dep", "chunk", "ne"])
    p.add_argument("system")
    p.add_argument("gold")
    a = p.parse_args(argv)
    found = api.evaluate_files(session(), a.system, a.gold, a.mode)
    if a.mode == "dep":
        print(evaluate.report(found.first()), end="")
    else:
        found.show(1000, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    commands = {"parse": parse, "learn": learn, "index": index, "eval": evaluation}
    if not argv or argv[0] in ("-h", "--help", "-v", "--version") or argv[0] not in commands:
        print(f"kakari {api.VERSION}: " + ", ".join(commands))
        return 0 if argv and argv[0].startswith("-") else 2
    return commands[argv[0]](argv[1:])


if __name__ == "__main__":
    sys.exit(main())
