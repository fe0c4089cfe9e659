"""Timings of the headline runs; prints one JSON line.

The field tables are first mapped from the given tables and written as Parquet
(``ingest``), as a user ingests databases once.  Every other run reads that.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame  # noqa: E402

from strataspark import model as m  # noqa: E402
from strataspark import mapped  # noqa: E402
from strataspark.operators import images, linking, markers, nested, points, selection  # noqa: E402
from strataspark.plans import export, webmap  # noqa: E402
from strataspark.plans.ingest import write_model  # noqa: E402
from strataspark.session import local_session  # noqa: E402
from strataspark.sinks.points import write_types  # noqa: E402


def run(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    rules = mapped.MAPPED_RULES
    timings: dict[str, float] = {}

    def timed(name: str, action: Callable[[], object]) -> None:
        begin = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - begin, 3)

    def ingest() -> None:
        given = mapped.field_model(spark, sf_dir)
        write_model(given, f"{work}/model")
        mapped.image_files(given).write.parquet(f"{work}/files")

    timed("ingest", ingest)
    model = m.FieldModel.from_parquet(spark, f"{work}/model")
    files = spark.read.parquet(f"{work}/files")

    def valid(kind: str) -> DataFrame:
        return points.filter_valid(export.compile_types(model, rules, [kind])[kind], kind)

    def linker() -> linking.Linker:
        return export.link_observations(model, rules)

    timed("valid_planars", lambda: run(valid(m.PLANARS)))
    timed("valid_linears", lambda: run(valid(m.LINEARS)))
    timed("rocks_with_textures", lambda: run(valid(m.ROCKS)))
    timed("images", lambda: run(valid(m.IMAGES)))
    timed("samples", lambda: run(valid(m.SAMPLES)))
    timed("textures", lambda: run(valid(m.TEXTURES)))
    timed(
        "selected_observations",
        lambda: run(selection.select_observations(model.observations, rules)),
    )
    timed(
        "resolve_tectonic",
        lambda: run(linking.resolve_tectonic(model.tectonics, [m.SRC, "OBSID"])),
    )
    timed("texture_tuples", lambda: run(linking.texture_tuples(model.textures)))
    timed("image_files", lambda: run(images.link_files(model.images, files)))
    timed("first_per_id", lambda: run(markers.first_per_id(model.observations)))
    timed("nested_observations", lambda: run(nested.nested_observations(linker())))
    timed("markers", lambda: run(webmap.compile_markers(model, rules, files, "imgs")))
    timed(
        "row_index",
        lambda: run(points.with_row_index(valid(m.LINEARS), [m.SRC, m.OBS_RID, m.RID])),
    )

    def export_all() -> None:
        with export.compiled_types(model, rules) as compiled:
            write_types(compiled, f"{work}/export", ["csv", "parquet"])

    timed("export_all_types", export_all)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
