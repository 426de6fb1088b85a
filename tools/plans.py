"""Write the physical plans of the headline queries to PLANS.md.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arborform.plans.catalog import QUERIES  # noqa: E402
from arborform.session import get_session  # noqa: E402

NAMES = ["features", "markup_leaves", "node_leaves", "pair_features", "half_split", "batch_ids",
         "fuse_sum", "metric_row", "vocab"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    out = ["# Physical plans of the headline queries", "",
           f"`python tools/plans.py {sf_dir}`: initial adaptive plans (AQE may still coalesce",
           "partitions or switch joins at run time). Attribute ids and file paths trimmed.", ""]
    for name in NAMES:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            QUERIES[name](spark, sf_dir).explain()
        text = re.sub(r"#\d+L?", "", buf.getvalue())
        text = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: ...", text)
        out += [f"## {name}", "", "```", text.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
