"""Command line: filter, smooth and report."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calculus, calibration, cleaning, filters, qa
from tidemark.plans.config import FilterConfig, SessionConfig, load_session_config
from tidemark.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Multi-sensor tracking on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("filter", "smooth"):
        s = sub.add_parser(name, help=f"{name} the sessions of a settings file")
        s.add_argument("--config", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--unscented", action="store_true")
        s.add_argument("--state-mode")
        if name == "smooth":
            s.add_argument("--num-iter", type=int, default=1)
    r = sub.add_parser("report", help="metrics of an estimate table against a truth table")
    r.add_argument("--run", required=True, help="Parquet with session_id, t, x, y, vx, vy, heading, nees")
    r.add_argument("--truth", required=True, help="Parquet with session_id, t and the _true columns")
    r.add_argument("--out", required=True)
    r.add_argument("--state-dim", type=int, default=10)
    return p


def named(estimates: DataFrame, cfg: FilterConfig, mean: str = "mean") -> DataFrame:
    """Positions, velocities and heading as columns of their own."""
    lay = cfg.layout
    at = lambda i: F.get(mean, F.lit(i))
    if lay.is_quaternion:
        w, x, y, z = (at(i) for i in lay.heading)
        heading = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    else:
        heading = at(lay.heading[0])
    return estimates.select("*", at(lay.position[0]).alias("x"), at(lay.position[1]).alias("y"), at(lay.velocity[0]).alias("vx"), at(lay.velocity[1]).alias("vy"), heading.alias("heading"))


def safety(session: files.Session, estimates: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Fused against vision-only estimates."""
    blind = replace(FilterConfig.vision_only(), led_distance=cfg.filter.led_distance)
    vision = named(filters.track(session.samples, session.frames, blind), blind).select("session_id", "frame", F.col("x").alias("vx_x"), F.col("y").alias("vx_y"))
    middle = cleaning.midpoint(session.frames).select("session_id", "t", "mx", "my")
    fused = named(estimates, cfg.filter).select("session_id", "frame", "t", "x", "y")
    return calculus.safety_report(fused.join(vision, ["session_id", "frame"]).join(middle, ["session_id", "t"]), cfg.safety)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "report":
        joined = spark.read.parquet(args.run).join(spark.read.parquet(args.truth), ["session_id", "t"])
        files.write_diagnostics(qa.report(joined, state_dim=args.state_dim), f"{args.out}/report")
        return
    cfg = load_session_config(args.config)
    if args.state_mode:
        cfg = replace(cfg, filter=replace(cfg.filter, state_mode=args.state_mode))
    session = files.load_session(spark, cfg)
    smooth = args.command == "smooth"
    out = filters.track(session.samples, session.frames, cfg.filter, args.unscented, smooth, getattr(args, "num_iter", 1))
    files.write_estimates(out, f"{args.out}/estimates")
    written = spark.read.parquet(f"{args.out}/estimates")
    if cfg.safety.run and cfg.filter.state_mode != "vision_only":
        verdict = safety(session, written, cfg)
        files.write_diagnostics(verdict, f"{args.out}/safety")
        if verdict.where("not passed").head(1):
            raise ValueError("the fused path is implausible against the camera; see the safety folder")
    if session.calibration is not None:
        files.write_diagnostics(session.calibration.withColumn("text", calibration.report_text()), f"{args.out}/calibration")
    if session.accounting is not None:
        files.write_diagnostics(session.accounting, f"{args.out}/events")
    totals = written.groupBy("session_id").agg(F.sum("loglik").alias("loglik"), F.count("*").alias("frames"), F.count_if("vision").alias("frames_with_vision"))
    files.write_diagnostics(totals, f"{args.out}/summary")
    files.write_metadata(spark, cfg, f"{args.out}/metadata", command=args.command)


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, or 1 with a message; TIDEMARK_DEBUG raises instead."""
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        run(args, spark)
    except (ValueError, KeyError, FileNotFoundError) as e:
        if os.environ.get("TIDEMARK_DEBUG"):
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
