"""The line format of hand-made question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse(files: DataFrame, first_id: int = 1_000_001) -> DataFrame:
    """(id, title, context, question, answers, sentence, answer_ne) of files (file_id, text).

    Lines are T: title, C: context, Q: question, A: answers parted by semicolons, S: sentence, A_NE: type of the answer;
    blank lines and those that begin with # or = are skipped. A title and a context hold until the next. Files are read in the order of their ids.
    """
    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(~F.col("line").rlike(r"^\s*$|^[#=]"))
    kind, value = F.regexp_extract("line", r"^(T|C|Q|A|S|A_NE):", 1), F.trim(F.regexp_replace("line", r"^(T|C|Q|A|S|A_NE):", ""))
    lines = lines.select("file_id", "no", kind.alias("kind"), value.alias("value")).where("kind <> ''")
    so_far = Window.partitionBy("file_id").orderBy("no")
    held = lambda k: F.last(F.when(F.col("kind") == k, F.col("value")), ignorenulls=True).over(so_far)
    rows = lines.select("*", held("T").alias("title"), held("C").alias("context"), F.sum((F.col("kind") == "Q").cast("int")).over(so_far).alias("q"))
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"_{k}")
    sets = rows.where("q > 0 and kind not in ('T', 'C')").groupBy("file_id", "q").agg(F.min("title").alias("title"), F.min("context").alias("context"), *(one(k) for k in ("Q", "A", "S", "A_NE")))
    counts = sets.groupBy("file_id").agg(F.max("q").alias("_k"))  # a row a file
    before = counts.select(F.col("file_id").alias("_f"), F.coalesce(F.sum("_k").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    answers = F.filter(F.transform(F.split("_A", ";"), lambda x: F.trim(x)), lambda x: x != "")
    sets = sets.join(before, sets["file_id"] == before["_f"])
    return sets.select((F.col("_before") + F.col("q") + F.lit(first_id - 1)).alias("id"), "title", "context", F.col("_Q").alias("question"), answers.alias("answers"), F.col("_S").alias("sentence"), F.col("_A_NE").alias("answer_ne"))
