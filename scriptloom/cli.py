"""Command line: analyze media, or only prepare their windows."""

from __future__ import annotations

import argparse
import sys

from .errors import MediaError, ScriptloomError
from .plans.analysis import BACKENDS, Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptloom", description="Analyze long audio and video with Spark.")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "prepare"):
        c = commands.add_parser(name)
        c.add_argument("source")
        c.add_argument("-o", "--output-dir", default="output")
        c.add_argument("--chunk-seconds", type=float, default=30.0)
        c.add_argument("--overlap-seconds", type=float, default=2.0)
        c.add_argument("--fps", type=float, default=1.0)
        c.add_argument("--max-edge", type=int, default=720)
        if name == "prepare":
            continue
        c.add_argument("--backend", choices=[b for b in BACKENDS if b != "transformers"], default="llama-cpp")
        for option in ("model", "source-language", "translate-to", "context", "server-url", "api-key-env", "media-root"):
            c.add_argument(f"--{option}", default=None)
        c.add_argument("--media-mode", choices=("base64", "file-url"), default="base64")
        c.add_argument("--max-new-tokens", type=int, default=4096)
        c.add_argument("--context-size", type=int, default=16384)
        c.add_argument("--timeout-seconds", type=float, default=3600.0)
        c.add_argument("--seed", type=int, default=7)
        c.add_argument("--no-stream", dest="stream", action="store_false")
        c.add_argument("--keep-alive", default="30m")
    return p


def config_of(args: argparse.Namespace) -> Config:
    given = {k: v for k, v in vars(args).items() if k not in ("command", "source", "context") and v is not None}
    return Config(**given | ({"user_context": args.context} if getattr(args, "context", None) else {}))


def run(args: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.memo import workspace_key
    from .operators.render import documents_json, markdown
    from .plans import analysis, windows
    from .sources import media as M
    from .sources.sinks import check_shared, staged, write_reports

    config = config_of(args)
    config.validate()
    M.identity(args.source)
    for tool in ("ffprobe", "ffmpeg"):
        M.require(tool)
    tell = lambda line: print(line, file=sys.stderr, flush=True)
    spark = SparkSession.builder.appName("scriptloom").getOrCreate()
    check_shared(spark, config.output_dir)
    files = M.media_files(spark, args.source).withColumn("source", F.regexp_replace("path", "^file:", ""))
    kept = workspace_key(F.col("path"), F.col("size"), F.col("modified"), *map(F.lit, (config.chunk_seconds, config.overlap_seconds, config.fps, config.max_edge)))
    tell(f"Looking at {args.source}...")
    info = staged(M.probed(M.probe_files(files.withColumn("media_id", kept))))
    if bad := info.where("error IS NOT NULL").select("source", "error").orderBy("source").head(5):
        raise MediaError("; ".join(f"{r['source']}: {r['error']}" for r in bad))
    plan = windows.plan_chunks(info, chunk=config.chunk_seconds, overlap=config.overlap_seconds)
    n = plan.count()
    tell(f"Cutting {n} windows of {info.count()} sources...")
    # a long source's windows are decoded by many tasks
    plan = plan.repartition(min(n, 8 * spark.sparkContext.defaultParallelism) or 1, "media_id", "index")
    plan = M.decode_chunks(plan.drop("modified"), f"{config.output_dir}/chunks", config.fps, config.max_edge)
    if args.command == "prepare":
        M.manifest(plan, ["source", "size"], ["duration_seconds", "width", "height", "has_audio", "has_video"], ["start_seconds", "chunk_seconds", "video_path", "audio_path", "frame_paths"]).write.mode("overwrite").json(f"{config.output_dir}/manifest")
        return
    tell("Analyzing...")
    chunks = plan.select("media_id", "index", "start_seconds", F.col("chunk_seconds").alias("duration_seconds"), "video_path", "audio_path", "frame_paths")
    docs, whole = analysis.analyze(info.select("media_id", "source", "media_type", "duration_seconds"), chunks, config, cache=f"{config.output_dir}/cache")
    whole.write.mode("overwrite").parquet(f"{config.output_dir}/chunks.parquet")
    told = markdown(docs, whole).select("media_id", "markdown").join(documents_json(docs, whole).select("media_id", "json"), "media_id")
    write_reports(docs.select("media_id", "source").join(told, "media_id"), config.output_dir)
    tell(f"Done: {config.output_dir}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args)
    except (ScriptloomError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        if type(e).__module__.startswith("pyspark."):  # raised inside a task: its last line says what
            print(f"error: {said(str(e))}", file=sys.stderr)
            return 2
        raise
    return 0


def said(trace: str) -> str:
    """The message of a package's own error in a task's trace, or the trace's first line."""
    own = [line.split(": ", 1)[1] for line in trace.splitlines() if line.lstrip().startswith("scriptloom.errors.") and ": " in line]
    return own[-1] if own else trace.strip().splitlines()[0]


if __name__ == "__main__":
    sys.exit(main())
