"""spark-submit jobs: ``train``, ``score``, ``explain`` and ``stream``."""

from __future__ import annotations

import argparse

from tabwright import config
from tabwright.operators.models import base_models
from tabwright.plans.batch_scoring import score_csv, score_json
from tabwright.plans.training import load_model, train_model
from tabwright.session import build_session
from tabwright.sources.readers import read_table, read_training_csv
from tabwright.streaming.score_stream import read_request_stream, score_stream, write_scores


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="tabwright")
    jobs = parser.add_subparsers(dest="job", required=True)
    train = jobs.add_parser("train")
    train.add_argument("--input", required=True, help="CSV file or folder, or a parquet folder")
    train.add_argument("--output", required=True)
    train.add_argument("--row-id", default="Id")
    train.add_argument("--target", default="SalePrice")
    train.add_argument("--models", nargs="*", default=None, help="names of the base models to compare")
    train.add_argument("--no-tuning", action="store_true")
    train.add_argument("--trials", type=int, default=config.SEARCH_TRIALS)
    train.add_argument("--parallelism", type=int, default=2)
    train.add_argument("--storage", choices=["memory", "table"], default="table")
    score = jobs.add_parser("score")
    score.add_argument("--input", required=True)
    score.add_argument("--model", required=True)
    score.add_argument("--output", required=True)
    score.add_argument("--max-rows", type=int, default=None)
    score.add_argument("--keep", nargs="*", default=[], help="columns of the input that the result repeats")
    explain = jobs.add_parser("explain")
    explain.add_argument("--input", required=True, help="JSON batches")
    explain.add_argument("--model", required=True)
    explain.add_argument("--output", required=True)
    stream = jobs.add_parser("stream")
    stream.add_argument("--input", required=True, help="folder of request records, one JSON object per line")
    stream.add_argument("--model", required=True)
    stream.add_argument("--output", required=True)
    stream.add_argument("--checkpoint", default=None)
    args = parser.parse_args(argv)

    spark = build_session(f"tabwright-{args.job}")
    if args.job == "train":
        read = read_table if args.input.rstrip("/").endswith("parquet") else read_training_csv
        table = config.TableConfig(row_id=args.row_id, target=args.target)
        trained = train_model(
            read(spark, args.input),
            table,
            base_models(names=args.models),
            run_tuning=not args.no_tuning,
            n_trials=args.trials,
            parallelism=args.parallelism,
            storage=args.storage,
            output=args.output,
        )
        print(trained.name, trained.metrics)
    elif args.job == "score":
        batch = score_csv(spark, args.input, args.output, load_model(spark, args.model), args.max_rows, args.keep)
        print(batch.summary.first().asDict())
    elif args.job == "explain":
        score_json(spark, args.input, load_model(spark, args.model), explain=True).write.mode("overwrite").json(args.output)
    else:
        model = load_model(spark, args.model)
        scored = score_stream(read_request_stream(spark, args.input), model.pipeline, model.expected, model.name)
        write_scores(scored, args.output, args.checkpoint).awaitTermination()


if __name__ == "__main__":
    main()
