"""Results: JSON sink and source, intervals as text, markdown tables, and the data behind figures."""

from __future__ import annotations

import json
import math
import platform
import subprocess
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def jsonable(obj: object) -> object:
    """Plain values all the way down; a value that isn't finite becomes null."""
    if isinstance(obj, Row):
        obj = obj.asDict(recursive=True)
    if isinstance(obj, dict):
        return {str(k): jsonable(v) for k, v in obj.items()}
    if isinstance(obj, (list, tuple, set)):
        return [jsonable(v) for v in obj]
    if isinstance(obj, np.ndarray):
        return jsonable(obj.tolist())
    if isinstance(obj, np.generic):
        obj = obj.item()
    if isinstance(obj, float) and not math.isfinite(obj):
        return None
    return obj


def git_hash(folder: str = ".") -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=folder, capture_output=True, text=True, check=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def save_results(name: str, payload: dict, folder: str, provenance: bool = True) -> str:
    """Sorted, indented JSON at folder/name.json. Without provenance, equal payloads give equal bytes."""
    out = dict(payload)
    if provenance:
        out["provenance"] = {"written_utc": datetime.now(UTC).isoformat(timespec="seconds"), "git": git_hash(), "python": platform.python_version(), "numpy": np.__version__}
    path = Path(folder) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(jsonable(out), indent=2, sort_keys=True) + "\n")
    return str(path)


def load_results(name: str, folder: str) -> dict:
    return json.loads((Path(folder) / f"{name}.json").read_text())


def ci_text(point: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """`p [lo, hi]`, or n/a where there is no interval."""
    f = f"%.{digits}f [%.{digits}f, %.{digits}f]"
    return F.when(point.isNull() | lo.isNull() | hi.isNull(), F.lit("n/a")).otherwise(F.format_string(f, point, lo, hi))


def markdown(table: DataFrame, columns: list[str], order: str, digits: int = 3) -> str:
    """A markdown table of a report, a row a result; nothing is fitted again."""
    cell = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = table.orderBy(order).select(*columns).collect()
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]]) + "\n"


_METRICS = ("balanced_accuracy", "macro_f1", "roc_auc")


def _number(v: float | None) -> str:
    return "n/a" if v is None else f"{v:.3f}"


def _interval(report: dict, metric: str) -> str:
    found = next((r for r in report["ci"] if r["metric"] == metric), None)
    if found is None or any(found[c] is None for c in ("point", "lo", "hi")):
        return "n/a"
    return f"{found['point']:.3f} [{found['lo']:.3f}, {found['hi']:.3f}]"


def console(name: str, report: dict) -> str:
    """A saved report as lines for a terminal: interval, and how many units lie above a half (a count, not a test)."""
    lines = [name]
    by = {r["metric"]: r for r in report["summary"]}
    for m in _METRICS:
        if m in by:
            lines.append(f"  {m:18} mean {_number(by[m]['mean'])}  interval {_interval(report, m)}  {by[m]['n_above_half']} of {by[m]['n_valid']} above 0.5")
    return "\n".join(lines) + "\n"


def console_baselines(split: str, baselines: dict[str, dict]) -> str:
    """Baselines of one split, a line each: name -> its metrics."""
    rows = [f"  {name:14} " + "  ".join(f"{m} {_number(b.get(m))}" for m in _METRICS) for name, b in baselines.items()]
    return "\n".join([f"baselines of {split}", *rows]) + "\n"


def _table(rows: list[tuple[str, dict]]) -> str:
    head = ["| protocol | balanced accuracy | ROC AUC |", "| --- | --- | --- |"]
    return "\n".join([*head, *(f"| {label} | {_interval(r, 'balanced_accuracy')} | {_interval(r, 'roc_auc')} |" for label, r in rows)]) + "\n"


def recording_table(saved: dict) -> str:
    """The markdown table of a saved recording_job; nothing is fitted again."""
    past = saved["chronological"]["pooled"][0]
    rows = [("expanding blocks", saved["expanding"]), ("merged blocks (primary)", saved["merged_blocks"]), ("merged blocks, prior", saved["merged_blocks_prior"]), ("native blocks (diagnostic)", saved["native_blocks"])]
    rows += [(f"merged blocks, {name}", r) for name, r in sorted(saved["secondary"].items())]
    single = [("shuffled (leaks)", saved["naive"][0]), ("chronological", past)]
    first = "".join(f"| {label} | {_number(r['balanced_accuracy'])} | {_number(r.get('roc_auc'))} |\n" for label, r in single)
    head, rule, *rest = _table(rows).splitlines()
    return f"{head}\n{rule}\n{first}" + "\n".join(rest) + "\n"


def trials_table(saved: dict, patterns: dict | None = None) -> str:
    """The markdown table of a saved trials_job, and of a spatial_job where there is one."""
    names = ("within_subject", "leave_one_run_out", "leave_one_subject_out", "unweighted_c_half", "random_forest")
    rows = [(n.replace("_", " "), saved[n]) for n in names if saved.get(n)]
    rows += [("patterns, " + n.replace("_", " "), r) for n, r in (patterns or {}).items()]
    return _table(rows)


def interval_bars(ci: DataFrame) -> DataFrame:
    """point with the lengths of its bars below and above, for a figure."""
    return ci.select("*", (F.col("point") - F.col("lo")).alias("below"), (F.col("hi") - F.col("point")).alias("above"))


def coefficient_dots(preds: DataFrame, means: DataFrame, names: list[str], k: int = 10, split: tuple[str, ...] = ("fold",)) -> DataFrame:
    """name, mean_coefficient, sign, and a dot for each fit, told apart by split: the k largest by absolute mean."""
    top = means.orderBy(F.abs("mean_coefficient").desc(), "name").limit(k)
    labels = F.array(*[F.lit(n) for n in names])
    dots = preds.where("coefficients IS NOT NULL").select(*split, "coefficients").dropDuplicates(list(split))
    dots = dots.select(*split, F.posexplode("coefficients").alias("_i", "value")).select(*split, F.element_at(labels, F.col("_i") + 1).alias("name"), "value")
    return dots.join(F.broadcast(top), "name").withColumn("sign", F.signum("mean_coefficient").cast("int"))
