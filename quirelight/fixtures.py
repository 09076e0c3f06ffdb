"""Original and translated chapters derived from the documents table, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAPTERS = """
WITH original_chapters AS (
  SELECT doc_id,
    lpad(CAST(doc_id AS STRING), 5, '0') AS chapter_key,
    CASE WHEN doc_id = 0 THEN '00_toc.md'
         WHEN doc_id % 97 = 0 THEN lpad(CAST(doc_id AS STRING), 5, '0') || '_report.md'
         WHEN doc_id % 89 = 0 THEN 'appendix_' || CAST(doc_id AS STRING) || '.md'
         ELSE lpad(CAST(doc_id AS STRING), 5, '0') || '_ch.md' END AS file_name,
    '# Item ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || text || chr(10) || chr(10)
    || 'Use String and ArrayList via valueOf(x); a static factory method is immutable.' || chr(10) || chr(10)
    || '```java' || chr(10) || 'public class A' || CAST(doc_id AS STRING) || ' {}' || chr(10) || '```' || chr(10) || chr(10)
    || '> note one' || chr(10) || '> note two' || chr(10) || chr(10)
    || '![fig](./images/' || CAST(doc_id AS STRING) || '.png)' || chr(10)
    || '<blockquote><p>int a = ' || CAST(doc_id AS STRING) || ';</p></blockquote>' || chr(10)
    || '<blockquote class="c">int   b =' || chr(10) || ' 1;</blockquote>' || chr(10)
    || '<img class="f" src="a/' || CAST(doc_id AS STRING) || '.png" alt="fig"/>' || chr(10) AS content
  FROM documents
),
translated_chapters AS (
  SELECT doc_id, chapter_key,
    chapter_key || '_zh.md' AS file_name,
    '# 条目 ' || CAST(doc_id AS STRING) || chr(10) || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '使用字符串与 ' ELSE '使用 String 与 ' END
    || 'ArrayList，调用valueOf方法；'
    || CASE WHEN doc_id % 4 = 0 THEN '静态工厂方法' WHEN doc_id % 4 = 1 THEN 'static factory method' ELSE '某方法' END
    || '是不可变的。' || chr(10) || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN ''
            ELSE '```java' || chr(10) || 'public class A' || CAST(doc_id AS STRING) || ' {}' || chr(10) || '```' || chr(10) || chr(10) END
    || CASE WHEN doc_id % 6 = 0 THEN '> 注一' || chr(10) || chr(10) ELSE '> 注一' || chr(10) || '> 注二' || chr(10) || chr(10) END
    || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '![图](./images/' || CAST(doc_id AS STRING) || '.png)' || chr(10) END
    || '<blockquote><p>int a = ' || CAST(doc_id AS STRING) || ';</p></blockquote>' || chr(10)
    || CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 2 = 0 THEN '<blockquote>int b = 1;</blockquote>'
            ELSE '<blockquote>int b = 2;</blockquote>' END || chr(10)
    || CASE WHEN doc_id % 17 = 0 THEN '' ELSE '<img src="a/' || CAST(doc_id AS STRING) || '.png" alt="'
            || CASE WHEN doc_id % 3 = 0 THEN '图片' WHEN doc_id % 3 = 1 THEN '' ELSE '代码截图' END || '"/>' END
    || chr(10) AS content
  FROM original_chapters
  WHERE doc_id % 11 <> 0
)
"""


def whole_ids(files: DataFrame) -> DataFrame:
    """files with ids of more than 5 digits whole in keys and names: the SQL's lpad cuts them to their first five."""
    full = F.col("doc_id").cast("string")
    cut = F.substring(full, 1, 5)
    long = F.length(full) > 5
    named = F.concat(full, F.expr("substring(file_name, 6)"))
    return files.select(
        "doc_id",
        F.when(long, full).otherwise(F.col("chapter_key")).alias("chapter_key"),
        F.when(long & F.startswith("file_name", F.concat(cut, F.lit("_"))), named).otherwise(F.col("file_name")).alias("file_name"),
        "content",
    )


def editions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(original, translated) chapters: doc_id, chapter_key, file_name, content."""
    view = f"_edition_documents_{zlib.crc32(sf_dir.encode())}"  # tables of several folders do not replace each other
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").createOrReplaceTempView(view)
    text = CHAPTERS.replace("FROM documents", f"FROM {view}")
    pick = "SELECT doc_id, chapter_key, file_name, content FROM "
    return whole_ids(spark.sql(text + pick + "original_chapters")), whole_ids(spark.sql(text + pick + "translated_chapters"))
