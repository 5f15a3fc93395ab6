"""Delimited exports for spreadsheets: one named file for each table, or numbered ones where a sheet could not hold it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered

#: Rows a spreadsheet can hold.
SHEET_ROWS = 1_048_575
#: Bytes of text in a file, on average: one task writes it, and reads it back whole.
SHEET_BYTES = 256 << 20
BOM = "﻿"
#: Quoting as spreadsheets read it: a field with a separator, quote or line end is quoted, quotes inside are doubled, and
#: blanks stay as they are.
QUOTING = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# fixed values: column titles of the exported tables
GROUP_COLUMNS = {"group_id": "组编号", "image_index": "图片序号", "image_name": "文件名", "source": "来源", "title": "提取标题",
                 "similarity": "组内相似度", "duplicate": "是否重复"}
PAIR_COLUMNS = {"a_index": "A序号", "a_title": "A标题", "b_index": "B序号(最相似)", "b_title": "B标题", "similarity": "相似度",
                "overlap": "A是否与B组重合", "overlap_b_index": "重合配对B序号", "verdict": "GSB判定", "reason": "判定理由"}
RUN_COLUMNS = {"created_at": "评测时间", "run_uid": "run_uid", "input_mode": "输入方式", "event_id": "event_id", "news_title": "新闻标题",
               "importance_score": "生产重要性分", "persona": "Agent", "persona_version": "Agent版本", "score": "评分", "human_score": "人工标注分",
               "understandable": "是否看得懂", "assessment": "定性评估", "reason": "看懂原因", "suggestion": "优化建议", "cost_usd": "成本USD", "model": "模型"}


def yes_no(flag: Column) -> Column:
    return F.when(flag, "是").when(~flag, "否").otherwise("")


def three_digits(x: Column) -> Column:
    return F.format_string("%.3f", x)


def group_table(groups: DataFrame) -> DataFrame:
    """Duplicate groups (group_id, image_index, image_name, source, title, similarity_to_group, is_duplicate) as exported."""
    return groups.select("group_id", "image_index", "image_name", "source", "title", three_digits(F.col("similarity_to_group")).alias("similarity"),
                         yes_no(F.col("is_duplicate")).alias("duplicate"))


def pair_table(pairs: DataFrame) -> DataFrame:
    """Compared pairs as exported; a pair without a matched counterpart has an empty last index."""
    return pairs.select("a_index", "a_title", "b_index", "b_title", three_digits(F.col("similarity")).alias("similarity"),
                        yes_no(F.col("is_overlap")).alias("overlap"), "overlap_b_index", "verdict", "reason")


def run_table(results: DataFrame, personas: DataFrame) -> DataFrame:
    """Evaluation results with the names of their personas; a failed one shows its error instead of a score."""
    names = personas.select(F.col("id").alias("_p"), F.col("name").alias("_name"))
    j = results.join(names, F.col("persona_id") == F.col("_p"), "left")
    gone = F.concat(F.col("persona_id").cast("string"), F.lit("（已删除）"))
    score = F.coalesce(F.col("score").cast("string"), F.concat(F.lit("失败："), F.coalesce("error", F.lit(""))))
    return j.select("created_at", "run_uid", "input_mode", "event_id", "news_title", "importance_score", F.coalesce("_name", gone).alias("persona"),
                    "persona_version", score.alias("score"), "human_score", yes_no(F.col("is_understandable")).alias("understandable"),
                    "assessment", "reason", "suggestion", "cost_usd", "model")


def export(df: DataFrame, titles: dict[str, str], folder: str, name: str, order: list[str], sep: str = "\t", bom: bool = False,
           sheet_rows: int = SHEET_ROWS, sheet_bytes: int = SHEET_BYTES) -> list[str]:
    """Write the columns of ``titles`` under their titles to ``folder``, sorted by ``order``, and return the file names.

    A table that a sheet can hold is one file ``name``.tsv (or .csv); a longer one becomes ``name``-1, ``name``-2, ..., each
    with the header, so that no task writes more than a sheet; long rows make shorter sheets, of ``sheet_bytes`` on average. ``bom`` puts the mark before the first title by which some
    programs tell UTF-8.
    """
    spark = df.sparkSession
    rows = numbered(df.select(*titles), order, "__row")
    size = rows.agg(F.count("*"), F.sum(F.octet_length(F.concat_ws("\t", *titles)))).first()
    if size[1]:
        sheet_rows = max(1, min(sheet_rows, sheet_bytes * size[0] // size[1]))
    rows = rows.withColumn("__sheet", F.floor((F.col("__row") - 1) / sheet_rows))
    sheets = (rows.agg(F.max("__sheet")).first()[0] or 0) + 1
    shown = list(titles.values())
    if bom:
        shown[0] = BOM + shown[0]
    fs, path = _fs(spark, folder)
    fs.mkdirs(path(folder))
    out = []
    work = f"{folder}/.work-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(sheets, "__sheet").sortWithinPartitions("__sheet", "__row")
    named = dealt.select(F.col("__sheet"), *[F.col(c).alias(t) for c, t in zip(titles, shown)])
    named.write.partitionBy("__sheet").options(sep=sep, header="true", **QUOTING).csv(work)
    for k in range(sheets):
        file = f"{name}{'' if sheets == 1 else f'-{k + 1}'}.{'tsv' if sep == chr(9) else 'csv'}"
        parts = [s.getPath() for s in fs.listStatus(path(f"{work}/__sheet={k}"))] if fs.exists(path(f"{work}/__sheet={k}")) else []
        parts = [p for p in parts if p.getName().startswith("part-")]
        if not parts:                                                     # an empty table: its header alone
            stream = fs.create(path(f"{folder}/{file}"), True)
            stream.write(bytearray((sep.join(shown) + "\n").encode()))
            stream.close()
        else:
            fs.delete(path(f"{folder}/{file}"), False)
            fs.rename(parts[0], path(f"{folder}/{file}"))
        out.append(file)
    fs.delete(path(work), True)
    return out


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_export(spark: SparkSession, paths: list[str], titles: dict[str, str], sep: str = "\t") -> DataFrame:
    """An exported table back under its column names, all as text; empty fields are null."""
    schema = ", ".join(f"`{c}` string" for c in titles)
    return spark.read.schema(schema).options(sep=sep, header="true", multiLine="true", enforceSchema="true", **{k: v for k, v in QUOTING.items() if k != "emptyValue"}).csv(paths)
