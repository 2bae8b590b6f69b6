"""Command line: `convert` a transcript to subtitles, or transcribe and diarize WAV files with a backend."""

from __future__ import annotations

import argparse
import sys

from .options import FORMATS, TASKS, TIMESTAMPS, PipelineOptions


def success_message(path: str, diarized: bool) -> str:
    # The wording that scripts around the command line look for.
    done = "transcribed & speaker segmented" if diarized else "transcribed"
    return f"Voila!✨ Your file has been {done} go check it out over here 👉 {path}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("speechframe")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("input_file")
    c.add_argument("-f", "--output_format", choices=FORMATS, required=True)
    c.add_argument("-o", "--output_dir", default=".")
    c.add_argument("--verbose", action="store_true")
    t = sub.add_parser("transcribe")
    t.add_argument("--file-name", required=True)
    t.add_argument("--device-id", default="0")
    t.add_argument("--transcript-path", default="output.json")
    t.add_argument("--model-name", default="base")
    t.add_argument("--task", choices=TASKS, default="transcribe")
    t.add_argument("--language", default="None")
    t.add_argument("--batch-size", type=int, default=24)
    t.add_argument("--timestamp", choices=TIMESTAMPS, default="chunk")
    t.add_argument("--token", default="no_token")
    t.add_argument("--flash", choices=("True", "False"), default="False")
    t.add_argument("--diarization_model", default="")
    for x in ("num", "min", "max"):
        t.add_argument(f"--{x}-speakers", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 1 for an error while running; argparse ends with 2 on bad usage."""
    p = parser()
    args = p.parse_args(argv)
    try:
        if args.command == "convert":
            from .sources.transcripts import convert_file

            convert_file(args.input_file, args.output_format, args.output_dir, args.verbose)
            return 0
        try:
            options = PipelineOptions(**{k: v for k, v in vars(args).items() if k != "command"} | {"flash": args.flash == "True"})
        except ValueError as e:
            p.error(str(e))
        from pyspark.sql import SparkSession

        from .operators.backend import TestBackend
        from .plans.pipelines import transcribe_files

        transcribe_files(SparkSession.builder.getOrCreate(), options, TestBackend())
        print(success_message(options.transcript_path, options.diarize))
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
