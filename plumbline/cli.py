"""Command line: audit, demo, export, serve and baseline record."""

from __future__ import annotations

import argparse
import sys

from plumbline.operators.validate import UsageError
from plumbline.operators.verdict import EXIT, INTERNAL_EXIT, USAGE_EXIT
from plumbline.plans import report as R
from plumbline.plans.config import ConfigError, load_config, select_metrics
from plumbline.plans.redact import redact

RENDER = {"json": R.to_json, "prometheus": R.to_prometheus, "markdown": R.to_markdown, "text": R.to_text}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("audit", "baseline"):
        a = sub.add_parser(name)
        a.add_argument("target")
        for opt, kind in (("queries", int), ("k", int), ("k-hub", int), ("hubness-sample-size", int), ("seed", int), ("max-memory-mb", int), ("group-by", str)):
            a.add_argument(f"--{opt}", type=kind)
        a.add_argument("--filter", help="field=value")
        a.add_argument("--only", action="append")
        a.add_argument("--skip", action="append")
        a.add_argument("--config")
        a.add_argument("--baseline")
        a.add_argument("--gate", choices=["absolute", "delta", "both"])
        a.add_argument("--strict", action="store_true")
        a.add_argument("--nprobe", type=int)
        a.add_argument("--ef-budget", type=int)
        a.add_argument("--format", choices=list(RENDER), default="text")
        a.add_argument("--output")
    v = sub.add_parser("serve")
    v.add_argument("target")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8000)
    v.add_argument("--config")
    v.add_argument("--budget", type=int)
    v.add_argument("--nprobe", type=int)
    v.add_argument("--no-audit", action="store_true", help="serve at once; an audit starts when it is asked for")
    e = sub.add_parser("export")
    e.add_argument("report")
    e.add_argument("--format", choices=list(RENDER), default="text")
    e.add_argument("--output")
    d = sub.add_parser("demo")
    d.add_argument("scenario")
    d.add_argument("--rows", type=int)
    d.add_argument("--size", default="small")
    d.add_argument("--format", choices=list(RENDER), default="text")
    d.add_argument("--output")
    return p


def _emit(text: str, output: str | None) -> None:
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "export":
        with open(args.report, encoding="utf-8") as f:
            rep = R.from_json(f.read())
        _emit(RENDER[args.format](rep), args.output)
        return EXIT[rep.verdict]
    from plumbline.plans.audit import gate, run_audit

    spark = _spark()
    if args.command == "demo":
        from plumbline.sources.base import open_target

        source = open_target(spark, f"synthetic://{args.scenario}?size={args.size}" + (f"&rows={args.rows}" if args.rows else ""))
        rep = run_audit(source, load_config(environ={}))
        _emit(RENDER[args.format](rep), args.output)
        return EXIT[rep.verdict]
    from plumbline.sources.base import open_target

    if args.command == "serve":
        from plumbline import service

        state = service.state_of(open_target(spark, args.target), load_config(args.config), {"nprobe": args.nprobe} if args.nprobe else None, args.budget)
        if not args.no_audit:
            state.start_audit()
        server = service.serve(state, args.host, args.port)
        sys.stderr.write(f"serving on http://{args.host}:{server.server_address[1]}\n")
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
        finally:
            server.server_close()
        return 0
    field, _, value = (args.filter or "").partition("=")
    if args.filter and not (field and value):
        raise UsageError("a filter is field=value")
    over = {n: getattr(args, n) for n in ("queries", "k", "k_hub", "hubness_sample_size", "seed", "max_memory_mb", "group_by")}
    over |= {"filter_field": field or None, "filter_value": value or None, "gate_mode": args.gate, "strict_unavailable": args.strict or None}
    if args.only or args.skip:
        over["metrics_enabled"] = select_metrics(args.only, args.skip)
    cfg = load_config(args.config, overrides=over)
    params = {k: v for k, v in (("nprobe", args.nprobe), ("ef_budget", args.ef_budget)) if v}
    rep = run_audit(open_target(spark, args.target), cfg, params)
    if args.command == "baseline":
        _emit(R.to_json(rep), args.output)
        if rep.verdict != "OK":
            sys.stderr.write(f"warning: the recorded baseline is {rep.verdict}\n")
        return 0
    final = rep.verdict
    if args.baseline:
        with open(args.baseline, encoding="utf-8") as f:
            final = gate(rep, R.from_json(f.read()), spark, cfg.gate_mode, cfg.strict_unavailable)
    _emit(RENDER[args.format](rep), args.output)
    return EXIT[final]


def main() -> None:
    try:
        sys.exit(run())
    except (UsageError, ConfigError, R.ReportError) as e:
        sys.stderr.write(f"error: {redact(str(e))}\n")
        sys.exit(USAGE_EXIT)
    except Exception as e:  # noqa: BLE001 - the exit code tells
        sys.stderr.write(f"internal error: {redact(str(e))[:500]}\n")
        sys.exit(INTERNAL_EXIT)


if __name__ == "__main__":
    main()
