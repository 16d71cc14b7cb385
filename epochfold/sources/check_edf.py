"""python -m epochfold.sources.check_edf PATH: exit 1 where a file isn't as long as its header says."""

from __future__ import annotations

import sys

from epochfold.session import get_spark
from epochfold.sources import edf


def main(paths: list[str]) -> int:
    spark = get_spark("check-edf", cores=1)
    found = spark.read.format("binaryFile").load(paths).select("path", "length", "content")
    bad = [(r.path, r.error) for r in edf.headers(found).where("error IS NOT NULL").collect()]
    for path, error in bad:
        print(f"{path}: {error}", file=sys.stderr)
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
