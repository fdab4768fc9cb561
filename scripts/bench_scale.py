"""Scale proof for the vector jobs: the fixture vectors replicated r times with a
small deterministic jitter (500 -> 5k -> 50k), timing the exact similarity join
(D6) and, up to a size limit, average-linkage clustering (H3).

usage: python scripts/bench_scale.py [sf_dir] [r ...]   -> one JSON line per r
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cairn.operators import clustering as cl  # noqa: E402
from cairn.operators import vectors as vx  # noqa: E402
from cairn.operators.util import materialize  # noqa: E402
from cairn.session import build_session  # noqa: E402

DISTANCE = 0.65
CLUSTER_UP_TO = 10_000


def replicated(spark, sf, r):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    k = F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("k")
    x = e.select("vec_id", "embedding", k)
    # jitter: 0.05 * sin(id * 7.3 + position); the copy k = 0 is the original vector
    vec = F.transform("embedding", lambda v, i: v + F.when(F.col("k") == 0, F.lit(0.0)).otherwise(
        F.lit(0.05) * F.sin((F.col("vec_id") * r + F.col("k")) * F.lit(7.3) + i)))
    return x.select((F.col("vec_id") * r + F.col("k")).alias("id"), vec.cast("array<float>").alias("vec"))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    rs = [int(a) for a in sys.argv[2:]] or [1, 10, 100]
    spark = build_session("local[8]", 16, extra={"spark.driver.memory": "16g"})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-scale-"))
    for r in rs:
        v = materialize(replicated(spark, sf, r), f"vec{r}")
        n = v.count()
        t0 = time.perf_counter()
        edges = materialize(vx.similar_pairs(v, DISTANCE), f"edges{r}")
        m = edges.count()
        t_pairs = time.perf_counter() - t0
        out = {"vectors": n, "edges": m, "similar_pairs_sec": round(t_pairs, 2)}
        if n <= CLUSTER_UP_TO:
            t0 = time.perf_counter()
            lab = cl.average_linkage(v, DISTANCE, edges=edges)
            sizes = lab.groupBy("cluster").count()
            out["clusters_ge2"] = sizes.filter("count >= 2").count()
            out["largest"] = sizes.agg(F.max("count")).first()[0]
            out["clustering_sec"] = round(time.perf_counter() - t0, 2)
        print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
