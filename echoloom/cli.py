"""Command line: python -m echoloom.cli species|individuals|validation|zone ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import facade
from .operators import validation
from .schema import MixtureConfig, PreprocessConfig, SplitConfig, TrackingConfig
from .sinks import files
from .sources.tables import read_truth_csv


def session(app: str = "echoloom") -> SparkSession:
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _number_or_name(value: str) -> str | float:
    try:
        return float(value)
    except ValueError:
        return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="echoloom")
    sub = top.add_subparsers(dest="command", required=True)
    clean = argparse.ArgumentParser(add_help=False)
    clean.add_argument("path")
    clean.add_argument("--fme-min-khz", type=float, default=18.0)
    clean.add_argument("--passage-gap-ms", "--sequence-gap-ms", type=float, default=100.0)
    clean.add_argument("--echo-gap-ms", type=float, default=10.0)
    clean.add_argument("--echo-fme-bins", type=float, default=1.0)

    s = sub.add_parser("species", parents=[clean], help="mixture of frequencies of a log")
    s.add_argument("--bandwidth-method", "--bandwidth", dest="bandwidth", type=_number_or_name, default="scott")
    s.add_argument("--bandwidth-scale", type=float, default=1.0)
    s.add_argument("--peak-prominence-ratio", dest="prominence", type=float, default=0.05)
    s.add_argument("--min-peak-distance-khz", type=float)
    s.add_argument("--max-components", type=int, default=8)
    s.add_argument("--grid-size", type=int, default=1000)
    s.add_argument("--flavor", choices=("canonical", "web"), default="canonical")
    s.add_argument("--n-init", type=int, default=10, help="starts of the fit: the first at the peaks, the others drawn")
    s.add_argument("--random-state", type=int, default=42, help="seed of the drawn starts")
    s.add_argument("--report-output", dest="report")
    s.add_argument("-o", "--output", dest="chart", help="folder for the histogram that a chart shows")
    s.add_argument("--show", action="store_true", help="print that histogram")

    i = sub.add_parser("individuals", parents=[clean], help="tracks of individuals in a log")
    i.add_argument("--echo-strategy", choices=("drop_later", "best_snr"), default="best_snr")
    i.add_argument("--min-passage-chirps", type=int, default=3)
    i.add_argument("--min-chirps-for-kde", dest="min_split_chirps", type=int, default=15)
    i.add_argument("--max-components", type=int, default=4)
    i.add_argument("--ici-tolerance-ratio", dest="ici_tolerance", type=float, default=0.30)
    i.add_argument("--fme-tolerance-bins", type=float, default=2.0)
    i.add_argument("--track-expiry-n-ici", dest="expiry_icis", type=float, default=3.0)
    i.add_argument("--min-track-chirps", dest="min_chirps", type=int, default=3)
    i.add_argument("--bootstrap-ici-ms", type=float, default=100.0)
    i.add_argument("--suspicious-short-ici-ms", type=float, default=45.0)
    i.add_argument("--report-output", dest="report")
    i.add_argument("--tracks-csv", dest="csv")
    i.add_argument("--plot-output", dest="charts", help="folder for the tables that charts show")
    i.add_argument("--plot-window-sec", type=float, default=30.0)
    i.add_argument("--plot-window-min", type=float, help="deprecated: minutes instead of seconds")

    v = sub.add_parser("validation", help="counting accuracy of a log against its truth").add_subparsers(dest="action", required=True)
    judged = argparse.ArgumentParser(add_help=False)
    judged.add_argument("--input", required=True)
    judged.add_argument("--truth", required=True)
    e = v.add_parser("evaluate", parents=[judged])
    e.add_argument("--dataset", default="dev")
    e.add_argument("--tracker-module")
    e.add_argument("--processed-dir", default="data/processed")
    e.add_argument("--plot-dir", default="plots/counting", help="folder for the tables that charts show")
    e.add_argument("--bootstrap-seed", type=int, default=validation.SEED)
    v.add_parser("profile", parents=[judged])

    z = sub.add_parser("zone", help="figures of a frequency band")
    z.add_argument("path")
    z.add_argument("--low-khz", type=float, default=22.0)
    z.add_argument("--high-khz", type=float, default=28.0)
    z.add_argument("--sequence-gap-ms", type=float, default=100.0)
    return top


def _config(a: argparse.Namespace, **more) -> PreprocessConfig:
    return PreprocessConfig(passage_gap_ms=a.passage_gap_ms, echo_gap_ms=a.echo_gap_ms, echo_bins=a.echo_fme_bins, fme_min_khz=a.fme_min_khz, **more)


def _report(text: str, path: str | None) -> None:
    print(text)
    if path:
        files.write_text(path, text + "\n")


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or session()
    if a.command == "species":
        mixture = MixtureConfig(a.bandwidth, a.bandwidth_scale, a.prominence, a.min_peak_distance_khz, a.max_components, a.grid_size, a.flavor, a.n_init, a.random_state)
        text, feed = facade.cluster_file(spark, a.path, _config(a), mixture, a.flavor)
        _report(text, a.report)
        if a.show:
            feed.show(80)
        if a.chart:
            feed.write.mode("overwrite").option("header", True).csv(a.chart)
    elif a.command == "individuals":
        split = SplitConfig(min_chirps=a.min_split_chirps, max_components=a.max_components)
        tracking = TrackingConfig(a.ici_tolerance, a.fme_tolerance_bins, a.expiry_icis, a.min_chirps, a.bootstrap_ici_ms, a.suspicious_short_ici_ms)
        counted = facade.count_file(spark, a.path, _config(a, strategy=a.echo_strategy, min_passage_chirps=a.min_passage_chirps), split, tracking)
        _report(files.counting_report(counted.summary), a.report)
        if a.report:
            files.write_track_lines(counted.tracks, f"{a.report}.tracks")
        if a.csv:
            files.write_tracks_csv(counted.tracks, a.csv)
        if a.charts:
            window = a.plot_window_sec if a.plot_window_min is None else 60 * a.plot_window_min
            for name, table in facade.activity_feeds(counted, int(window * 1000)).items():
                table.write.mode("overwrite").option("header", True).csv(f"{a.charts}/{name}")
    elif a.command == "zone":
        print(facade.summarize_zone(spark, a.path, a.low_khz, a.high_khz, a.sequence_gap_ms))
    elif a.action == "profile":
        for name, value in validation.profile(facade.load(spark, a.input)[0], read_truth_csv(spark, a.truth)).items():
            print(f"{name}: {value:.6g}")
    else:
        _, summary, _ = facade.evaluate_files(spark, a.input, a.truth, a.processed_dir, a.dataset, a.tracker_module, a.bootstrap_seed, a.plot_dir)
        for row in summary.collect():
            print(f"{row['group']:<30} n={row['n_scenarios']:5d} bias={row['bias_mean']:+.3f} mae={row['mae']:.3f} rmse={row['rmse']:.3f} exact={row['exact_rate']:.1%}")


if __name__ == "__main__":
    main()
