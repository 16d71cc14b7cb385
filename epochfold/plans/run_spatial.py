"""python -m epochfold.plans.run_spatial RECORDINGS RESULTS: spatial patterns of band-passed epochs, as JSON.

Without recordings there is nothing to evaluate: the run says so and ends with status 0.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.errors import AnalysisException

from epochfold.plans import jobs
from epochfold.session import get_spark
from epochfold.sources import edf, results


def main(args: list[str]) -> int:
    recordings, folder = args
    spark = get_spark("spatial")
    try:
        found = edf.files(spark, recordings)
        empty = found.isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = True
    if empty:
        print(f"skipped: no recordings in {recordings}")
        return 0
    out = jobs.spatial_job(edf.trials(found), row_id="trial_id")
    path = results.save_results("spatial", out, folder)
    print("".join(results.console(name, report) for name, report in out.items()) + str(Path(path)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
