"""``python -m corpusloom process|tfidf|search|similarity|benchmark CORPUS OUT [QUERY]``."""

import sys

from pyspark.sql import SparkSession

from corpusloom.plans.commands import run

if __name__ == "__main__":
    if len(sys.argv) < 4:
        sys.exit(__doc__)
    run(SparkSession.builder.appName("corpusloom").getOrCreate(), *sys.argv[1:])
