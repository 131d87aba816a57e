"""Statement files of several companies compared: metrics, ratios, a JSON document and a spreadsheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import statements as S
from ..sources import files, spreadsheets, workbook


def compared(cells: DataFrame) -> DataFrame:
    """A row per company with its metrics and ratios, of cells (company, statement_type, section_pos, row_pos, label, value_raw of the first period)."""
    wide = S.company_metrics(cells).groupBy("company").pivot("metric", list(V.METRIC_ALIASES)).agg(F.first("value"))
    return S.ratios(wide)


def compare_files(spark: SparkSession, paths: dict[str, str], folder: str) -> DataFrame:
    """compared() of each company's statement files, saved as folder/peer_comparison (JSON lines) and folder/peer_comparison.xlsx."""
    first = lambda company, path: S.flatten(files.statements(spark, path)).where("period_pos = 0").select(F.lit(company).alias("company"), "statement_type", "section_pos", "row_pos", "label", "value_raw")
    out = compared(reduce(DataFrame.unionByName, (first(c, p) for c, p in paths.items())))
    out.write.mode("overwrite").json(f"{folder}/peer_comparison")
    metrics = [c for c in out.columns if c != "company"]
    tall = out.select("company", F.explode(F.array(*(F.struct(F.lit(m).alias("Metric"), F.col(m).alias("v")) for m in metrics))).alias("x")).select("company", "x.*")
    wide = tall.groupBy("Metric").pivot("company", sorted(paths)).agg(F.first("v"))
    cells = workbook.comparison_cells(wide, "Comparison", "Metric").withColumn("name", F.lit("peer_comparison.xlsx"))
    spreadsheets.save(workbook.files(cells), folder)
    return out
