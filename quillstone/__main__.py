"""python -m quillstone index DUMP OUT | search INDEX QUERIES"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .plans.build import build_index, search_index
from .sources.pages import read_dump, read_queries


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in ("index", "search"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    if args[0] == "index":
        print(build_index(read_dump(spark, args[1]), args[2]).first().asDict())
        return 0
    began = time.time()
    found = search_index(spark, args[1], read_queries(spark, args[2])).orderBy("query_id", "rank")
    last = None
    for r in found.toLocalIterator():
        if last is not None and r["query_id"] != last:
            print()
        print(r["title"])
        last = r["query_id"]
    print(f"{time.time() - began:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
