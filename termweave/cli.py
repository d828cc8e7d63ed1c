"""Commands: build a dictionary, import a release, evaluate a dataset, match a file of requests."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from termweave.config import Settings
from termweave.plans import evaluate, match
from termweave.sources import audit, evaluation, terms


def main(argv: list[str] | None = None) -> None:
    settings = Settings.from_env()
    parser = argparse.ArgumentParser(prog="termweave")
    verbs = parser.add_subparsers(dest="verb", required=True)
    build = verbs.add_parser("build")
    build.add_argument("--source", default=settings.source_terms_path)
    build.add_argument("--output", default=settings.artifact_path)
    build.add_argument("--version")
    load = verbs.add_parser("import-release")
    load.add_argument("source")
    load.add_argument("output")
    load.add_argument("--max-concepts", type=int)
    judge = verbs.add_parser("evaluate")
    judge.add_argument("dataset")
    run = verbs.add_parser("match")
    run.add_argument("requests")
    health = verbs.add_parser("health")
    health.add_argument("--artifact", default=settings.artifact_path)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("termweave").getOrCreate()
    if args.verb == "build":
        print(terms.build_from_file(spark, args.source, args.output, args.version).version)
    elif args.verb == "import-release":
        terms.write_csv_terms(terms.read_release(spark, args.source, args.max_concepts), args.output)
    elif args.verb == "evaluate":
        report = evaluate.evaluate(evaluation.sound(evaluation.read_records(spark, args.dataset)), terms.read_dictionary(spark, settings.artifact_path))
        print(json.dumps({k: [r.asDict(recursive=True) for r in v.collect()] for k, v in report.items()}, ensure_ascii=False))
    elif args.verb == "match":
        dictionary = terms.read_dictionary(spark, settings.artifact_path)
        requests = match.requests_of(spark.read.schema(match.REQUEST).json(args.requests))
        if left_out := match.rejected(requests).count():
            print(json.dumps({"rejected_requests": left_out}))
        requests = requests.where(match.valid_request())
        found = match.match(requests, dictionary, settings.review_threshold, settings.force_review_margin, settings.suspect_threshold, settings.max_span_tokens)
        audit.save_matches(match.responses(requests, found, dictionary.version), settings.audit_path)
    else:
        dictionary = terms.read_dictionary(spark, args.artifact)
        print(json.dumps({"status": "ok", "artifact_version": dictionary.version, "entries": dictionary.entries.count(), "auto_commit": False}))


if __name__ == "__main__":
    main()
