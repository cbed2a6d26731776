"""``python -m kinlink --data-dir D --out-dir O [--splits train test]``: normalise the sources."""

import argparse

from pyspark.sql import SparkSession

from kinlink.sources.io import normalize_files

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    p.add_argument("--data-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--splits", nargs="*", default=["train", "test"])
    a = p.parse_args()
    normalize_files(SparkSession.builder.getOrCreate(), a.data_dir, a.out_dir, tuple(a.splits))
