"""python -m lexispark build LIBRARY INDEX | search INDEX MODE QUERY | delete INDEX

Modes: boolean, positional, joker. Paths may be of any file system that Spark knows.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.index import CacheError, Index
from .operators.search import Searcher


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """0, or 2 with the reason on stderr where the call, a path or the query is wrong."""
    try:
        match args:
            case ["build", library, path]:
                spark = spark or SparkSession.builder.appName("lexispark").getOrCreate()
                index = Index.build_library(spark, library)
                index.save(path)
                print(f"{index.docs.count()} documents, {index.vocab.count()} terms")
                index.release()
            case ["search", path, mode, query]:
                spark = spark or SparkSession.builder.appName("lexispark").getOrCreate()
                for row in Searcher(Index.load(spark, path)).search(mode, query).toLocalIterator():
                    print(row.name)
            case ["delete", path]:
                spark = spark or SparkSession.builder.appName("lexispark").getOrCreate()
                if not Index.present(spark, path):
                    raise CacheError(f"no index in {path}")
                Index.delete(spark, path)
            case _:
                raise ValueError(__doc__.strip())
    except (ValueError, KeyError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
