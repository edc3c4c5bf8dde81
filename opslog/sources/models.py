"""The tables of a trained model, saved together and published at once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

PARTS = ("templates", "vocabulary", "scaler", "forest")
#: What a one-class SVM has in place of the forest.
MACHINE = "machine"


@dataclass(frozen=True)
class Model:
    """Template catalogue, vocabulary with idf, scaler row, and a detector of either kind:
    forest nodes with the offset, or the weights of a one-class SVM."""

    templates: DataFrame
    vocabulary: DataFrame
    scaler: DataFrame
    forest: DataFrame | None = None
    machine: DataFrame | None = None

    @property
    def parts(self) -> tuple[str, ...]:
        return PARTS if self.machine is None else (*PARTS[:3], MACHINE)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _published(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    """Number, folder and detector of the version that counts."""
    versions = _read(spark, f"{path}/published")
    row = versions.orderBy(F.desc("number"), "version").first() if versions is not None else None
    return row and (row["number"], f"{path}/{row['version']}", row["detector"])


def save_model(model: Model, path: str) -> None:
    """Write all parts to a folder of their own, then name it in ``published``.

    The last step adds one file, so a reader sees either the former model or the whole new one, also
    if writing breaks off. Former versions may be deleted once no reader uses them.
    """
    parts = {part: getattr(model, part) for part in model.parts}
    missing = [part for part, df in parts.items() if df is None]
    if missing:
        raise ValueError(f"The model lacks {', '.join(missing)}")
    spark, version = parts["scaler"].sparkSession, f"version-{uuid.uuid4().hex}"
    for part, df in parts.items():
        df.write.parquet(f"{path}/{version}/{part}")
    last = _published(spark, path)
    row = [(last[0] + 1 if last else 1, version, model.parts[-1])]
    spark.createDataFrame(row, "number long, version string, detector string").coalesce(1).write.mode("append").parquet(
        f"{path}/published")


def load_model(spark: SparkSession, path: str) -> Model:
    """Load all parts of the published version; missing ones are named together."""
    number, folder, detector = _published(spark, path) or (0, path, PARTS[-1])
    found = {part: _read(spark, f"{folder}/{part}") for part in (*PARTS[:3], detector)}
    missing = [part for part, df in found.items() if df is None]
    if missing:
        raise FileNotFoundError(f"Model parts are missing from {folder}: {', '.join(missing)}")
    return Model(**found)
